"""CAD drawings: tags, entities, vertices, proxy blobs.

Vertices stay in long form (file, ent_no, v_no, x, y); no polyline is collected into a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waterloom.functions.numbers import float_prefix, int_prefix, trim
from waterloom.operators.ordered import Sequence
from waterloom.session import materialize
from waterloom.sources.dispatch import list_files
from waterloom.sources.lines import scanned_lines
from waterloom.sources.parts import below_common_folder, write_parts

# Entity types and layers the selective scan keeps.
ENTITY_TYPES = ["INSERT", "LWPOLYLINE", "MTEXT", "TEXT", "LINE"]
RELEVANT_LAYERS = [
    "EU 1_Regards", "EU 1_Regards_Habillage", "EU 1_Canalisations",
    "EU 1_Canalisations_Habillage", "DN 200", "assai", "assai 250", "pvc 200",
    "New_EU 1_Canalisations_Pen_No__14",
]
PROFILE_TEXT_LAYER = r"^EU\s+1_PL_.*_Textes$"
# Layers of proxy entities and the network each belongs to.
PROXY_LAYERS = {
    "C-STRM-PIPE": "storm", "C-STRM-STRC": "storm", "C-STRM-TEXT": "storm",
    "C-SSWR-PIPE": "sanitary", "C-SSWR-STRC": "sanitary", "C-SSWR-TEXT": "sanitary",
}


def _slices(df: DataFrame) -> str | None:
    return "block" if "block" in df.columns else None


def tags_from_lines(lines: DataFrame) -> DataFrame:
    """Pair code lines with value lines: file, tag_no, code, value.

    A line that is no number cannot be a code and is skipped where a code is due.  It always
    leaves the scan waiting for a code, so the role of any line is the parity of its distance
    from the last such line, which a carried value answers without a sequential pass.
    """
    seq = Sequence(
        lines.withColumn("_code", int_prefix(F.col("text"))), "file", "line_no",
        slice_by=_slices(lines),
    ).compute(
        last_before={"_reset": F.when(F.col("_code").isNull(), F.col("line_no"))},
        following={"value": F.col("text")},
    )
    distance = F.col("line_no") - F.coalesce("_reset", F.lit(-1)) - 1
    keep = ["block"] if "block" in lines.columns else []
    return seq.df.where(
        F.col("_code").isNotNull() & (distance % 2 == 0) & F.col("value").isNotNull()
    ).select("file", F.col("line_no").alias("tag_no"), F.col("_code").cast("int").alias("code"),
             "value", *keep)


#: Splits whose starts every task may hold; more are joined and sorted instead.
HELD_SPLITS = 100_000
TAG = "file string, block bigint, tag_no bigint, code int, value string"


def _split_starts(raw: DataFrame, whole: bool = False) -> DataFrame:
    """Per split: its first line number, the last line before it that is no number, and the
    first line of the split that follows.

    With ``whole`` also the code line before it (``_before``) and whether the file's last line has
    no line end (``_open``): with one, lines and line ends make up the size of the file.
    """
    more = [F.max_by("text", "_mid").alias("_tail"), F.max("size").alias("_size"), F.sum(
        F.length("text") + F.length("ending")).alias("_bytes")] if whole else []
    splits = raw.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("_lines"), F.min("_mid").alias("_first"),
        F.max(F.when(F.col("code").isNull(), F.col("_mid"))).alias("_last_text"),
        F.min_by("text", "_mid").alias("_head"), *more,
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = splits.withColumn("_at", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    reset = F.col("_at") + F.col("_last_text") - F.col("_first")
    files = Window.partitionBy("file")
    more = [F.lag("_tail").over(order).alias("_before"),
            (F.sum("_bytes").over(files) > F.col("_size")).alias("_open")] if whole else []
    return numbered.withColumn("_reset", reset).select(
        "file", "block", "_at", "_first", (F.col("_at") + F.col("_lines") - 1).alias("_end"),
        F.coalesce(F.last("_reset", ignorenulls=True).over(before), F.lit(-1)).alias("_reset"),
        F.lead("_head").over(order).alias("_next"), *more,
    )


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair codes with the lines after them, over lines in order, splits one after the other.

    What is carried from batch to batch is the place of the last line that is no number and the
    last line itself, whose value may open the next batch.
    """
    reset = -1
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        line, at, end, entry = (batch[c].to_numpy() for c in ("line", "_at", "_end", "_reset"))
        plain = batch["code"].is_null().to_numpy(zero_copy_only=False)
        n = len(line)
        known = np.full(n, np.iinfo(np.int64).min)
        known[1:][plain[:-1]] = line[:-1][plain[:-1]]
        first = line == at
        known[first] = entry[first]
        if not first[0]:
            known[0] = reset
        latest = np.maximum.accumulate(np.where(known != np.iinfo(np.int64).min, np.arange(n), 0))
        last = known[latest]
        open_ = line[-1] != end[-1]  # the last line waits for its value
        use = ~plain & ((line - last - 1) % 2 == 0)
        use[-1] &= not open_
        closing = pa.array(line == end)
        shifted = pa.concat_arrays([batch["text"].slice(1), pa.nulls(1, pa.string())])
        value = pc.if_else(closing, batch["_next"], shifted)
        mask = pc.and_(pa.array(use), pc.is_valid(value))
        yield pa.RecordBatch.from_arrays(
            [batch["file"].filter(mask), batch["block"].filter(mask), batch["line"].filter(mask),
             batch["code"].filter(mask).cast(pa.int32(), safe=False), value.filter(mask)],
            names=["file", "block", "tag_no", "code", "value"])
        held = batch.slice(n - 1) if open_ else None
        reset = int(last[-1])


def read_tags(spark: SparkSession, path, **options) -> DataFrame:
    """Tags of one or many drawings: file, tag_no, code, value, block.

    The text is read twice and never shuffled or sorted: one aggregate gives each split its first
    line number and the role of its first line, then every task pairs the lines it reads.
    """
    raw = scanned_lines(spark, path, **options).withColumn("code", int_prefix(F.col("text")))
    starts = materialize(_split_starts(raw))
    few = starts.count() <= HELD_SPLITS
    joined = raw.join(F.broadcast(starts) if few else starts, ["file", "block"]).select(
        "file", "block", (F.col("_at") + F.col("_mid") - F.col("_first")).alias("line"), "code",
        "text", "_at", "_end", "_reset", "_next")
    if not few:
        joined = joined.repartition("file", "block").sortWithinPartitions("file", "line")
    return joined.mapInArrow(_pair, TAG).select("file", "tag_no", "code", "value", "block")


def section_spans(tags: DataFrame) -> DataFrame:
    """Sections of a drawing, a few rows per file: file, section, first and last tag."""
    starts = tags.where((F.col("code") == 0) & (trim(F.col("value")) == "SECTION")).select(
        "file", F.col("tag_no").alias("first"), (F.col("tag_no") + 2).alias("tag_no"))
    names = tags.where(F.col("code") == 2).select(
        "file", "tag_no", trim(F.col("value")).alias("section"))
    ends = tags.where((F.col("code") == 0) & (trim(F.col("value")) == "ENDSEC")).select(
        "file", F.col("tag_no").alias("first"), F.lit(None).cast("string").alias("section"))
    marks = starts.join(names, ["file", "tag_no"]).select("file", "first", "section").unionByName(
        ends)
    spans = Sequence(marks, "file", "first").following(last=F.col("first")).df
    return spans.where(F.col("section").isNotNull())


def mark_entities(tags: DataFrame, section: str = "ENTITIES") -> DataFrame:
    """Tags of one section with entity number (tag_no of its start), type and block depth."""
    # a few rows a file, written so that their size is known and the tags need not be moved
    span = materialize(section_spans(tags).where(F.col("section") == section).select(
        "file", "first", "last"))
    inside = tags.join(span, "file").where(
        (F.col("tag_no") > F.col("first") + 2)
        & (F.col("last").isNull() | (F.col("tag_no") < F.col("last")))
    ).drop("first", "last").withColumn("value", trim(F.col("value")))
    start = F.col("code") == 0
    step = F.when(start & (F.col("value") == "BLOCK"), 1).when(
        start & (F.col("value") == "ENDBLK"), -1).otherwise(0)
    return Sequence(inside, "file", "tag_no", slice_by=_slices(tags)).compute(
        last={"ent_no": F.when(start, F.col("tag_no")), "type": F.when(start, F.col("value"))},
        sums={"depth": step},
    ).df


def relevant_layer(layer: Column, layers: list[str] | None = None) -> Column:
    return layer.isin(layers or RELEVANT_LAYERS) | layer.rlike(PROFILE_TEXT_LAYER)


def model_space(
    marked: DataFrame, types: list[str] | None = None, layer: Column | None = None
) -> DataFrame:
    """Entity tags of the ENTITIES section; type and layer are tested before assembly.

    ``layer`` is a predicate over the column ``value`` of layer tags; entities failing it are
    removed by a semi-join, so their other tags never reach the grouping.
    """
    kept = marked.where(F.col("type").isin(types)) if types else marked
    if layer is not None:
        wanted = kept.where((F.col("code") == 8) & layer).select("file", "ent_no")
        kept = kept.join(wanted, ["file", "ent_no"], "left_semi")
    return kept


def entities(kept: DataFrame) -> DataFrame:
    """One row per entity from its tags (last tag of a code wins)."""
    def last(code: int) -> Column:
        return F.max_by("value", F.when(F.col("code") == code, F.col("tag_no")))

    def real(code: int) -> Column:
        return float_prefix(last(code))

    used = kept.where(F.col("code").isin(0, 1, 2, 5, 8, 10, 20, 11, 21, 50, 70, 71, 90))
    return used.groupBy("file", "ent_no", "type").agg(
        last(8).alias("layer"), last(2).alias("block_name"), last(1).alias("text"),
        last(5).alias("handle"), real(10).alias("x"), real(20).alias("y"),
        real(11).alias("x2"), real(21).alias("y2"), real(50).alias("rotation"),
        (F.coalesce(int_prefix(last(70)), F.lit(0)) % 2 == 1).alias("closed"),
        int_prefix(last(71)).cast("int").alias("degree"),
        int_prefix(last(90)).cast("int").alias("declared"),
    )


def vertices(kept: DataFrame) -> DataFrame:
    """Vertices of polylines and splines: file, ent_no, v_no, x, y.

    Cut to the declared vertex count where there is one.
    """
    shapes = kept.where(F.col("type").isin("LWPOLYLINE", "SPLINE"))
    points = shapes.where(F.col("code").isin(10, 20))
    paired = Sequence(points, ["file", "ent_no"], "tag_no", slice_by=_slices(kept)).compute(
        following={"_nc": F.col("code"), "_nv": F.col("value")},
        sums={"v_no": F.when(F.col("code") == 10, 1).otherwise(0).cast("bigint")},
    ).df.where(F.col("code") == 10)
    y = F.when(F.col("_nc") == 20, float_prefix(F.col("_nv"))).otherwise(F.lit(0.0))
    numbered = paired.select("file", "ent_no", "v_no", float_prefix(F.col("value")).alias("x"),
                             y.alias("y"))
    limit = shapes.where((F.col("code") == 90) & (F.col("type") == "LWPOLYLINE")).groupBy(
        "file", "ent_no"
    ).agg(int_prefix(F.max_by("value", "tag_no")).alias("_max"))
    joined = numbered.join(limit, ["file", "ent_no"], "left")
    return joined.where(
        F.col("_max").isNull() | (F.col("_max") <= 0) | (F.col("v_no") <= F.col("_max"))
    ).select("file", "ent_no", "v_no", "x", "y")


def proxy_entities(marked: DataFrame) -> DataFrame:
    """Model-space proxy entities on network layers with their hex blob.

    A blob is the content of one entity and is decoded as a whole, so it is one value.
    """
    tags = model_space(
        marked.where(F.col("depth") == 0), ["ACAD_PROXY_ENTITY"],
        F.col("value").isin(list(PROXY_LAYERS)),
    ).where(F.col("code").isin(5, 8, 92, 93, 310))

    def last(code: int) -> Column:
        return F.max_by("value", F.when(F.col("code") == code, F.col("tag_no")))

    grouped = tags.groupBy("file", "ent_no").agg(
        last(5).alias("handle"), last(8).alias("layer"), last(92).alias("_size"),
        F.min(F.when(F.col("code") == 93, F.col("tag_no"))).alias("_end"),
        F.collect_list(F.when(F.col("code") == 310, F.struct("tag_no", "value"))).alias("_chunks"),
    ).where((F.col("handle") != "") & F.col("layer").isin(list(PROXY_LAYERS)))
    inside = F.filter(
        F.array_sort("_chunks"),
        lambda c: F.col("_end").isNull() | (c["tag_no"] < F.col("_end")),
    )
    blob = F.array_join(F.transform(inside, lambda c: c["value"]), "")
    size = F.coalesce(int_prefix(F.col("_size")), F.lit(0))
    network = F.create_map(*[F.lit(v) for kv in PROXY_LAYERS.items() for v in kv])
    return grouped.select(
        "file", "ent_no", "handle", "layer", F.element_at(network, F.col("layer")).alias("network"),
        F.when(size > 0, F.substring(blob, F.lit(1), (size * 2).cast("int"))).otherwise(blob)
        .alias("hex"),
    )


def insert_blocks(marked: DataFrame) -> DataFrame:
    """Model-space block references: file, ent_no, block_name, layer, x, y."""
    found = entities(model_space(marked, ["INSERT"]))
    return found.select(
        "file", "ent_no", F.coalesce("block_name", F.lit("")).alias("block_name"),
        F.coalesce("layer", F.lit("")).alias("layer"), F.coalesce("x", F.lit(0.0)).alias("x"),
        F.coalesce("y", F.lit(0.0)).alias("y"),
    )


def drawing_format(tags: DataFrame) -> DataFrame:
    """Per file: ``proxy`` when a proxy network layer is named in it, else ``plain``."""
    named = F.col("value").rlike("C-STRM-(PIPE|STRC|TEXT)|C-SSWR-(PIPE|STRC|TEXT)")
    return tags.groupBy("file").agg(
        F.when(F.bool_or(named), "proxy").otherwise("plain").alias("format")
    )


def rename_names(
    tags: DataFrame, layer_names: DataFrame | None = None, block_names: DataFrame | None = None
) -> DataFrame:
    """Replace layer and block names in tags of code 8 and 2, everything else kept as is.

    Rename tables have ``old`` and ``new``.  Layer renames apply to both codes, block renames
    to code 2.  All renames apply at once, so one never feeds another.
    """
    out = tags.withColumn("_new", F.lit(None).cast("string"))
    for table, codes in ((layer_names, [8, 2]), (block_names, [2])):
        if table is None:
            continue
        names = table.select(F.col("old").alias("value"), F.col("new").alias("_to"))
        out = out.join(names, "value", "left").withColumn(
            "_new", F.coalesce("_new", F.when(F.col("code").isin(codes), F.col("_to")))
        ).drop("_to")
    return out.withColumn("renamed", F.col("_new").isNotNull()).withColumn(
        "value", F.coalesce("_new", "value")
    ).select(*tags.columns, "renamed")


def rename_in_lines(
    lines: DataFrame, layer_names: DataFrame | None = None, block_names: DataFrame | None = None
) -> DataFrame:
    """Rename layers and blocks in the lines of a drawing, every other byte untouched.

    Only the renamed values and their code lines (padded to three) differ from the input.
    """
    tags = rename_names(tags_from_lines(lines), layer_names, block_names).where("renamed")
    changed = tags.select(
        "file", F.inline(F.array(
            F.struct(F.col("tag_no").alias("line_no"),
                     F.lpad(F.col("code").cast("string"), 3, " ").alias("_t")),
            F.struct((F.col("tag_no") + 1).alias("line_no"), F.col("value").alias("_t")),
        )),
    )
    return lines.join(changed, ["file", "line_no"], "left").withColumn(
        "text", F.coalesce("_t", "text")
    ).drop("_t")


#: Names every task may hold while it copies drawings; with more the lines are joined instead.
HELD_NAMES = 100_000


def _copy(names: dict[int, tuple[list[str], list[str]]]):
    """Lines of whole splits, in order, with renamed values and their code lines replaced.

    A line is a value when the line before it is a code in use.  The roles follow from the last
    line that is no number, as in ``_pair``; the last line of a batch waits for the one after it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = {c: pa.array(o, pa.string()) for c, (o, _) in names.items()}
        new = {c: np.array(n, object) for c, (_, n) in names.items()}
        reset, before, held = -1, np.nan, None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            n = batch.num_rows
            if not n:
                continue
            line, at, end, entry = (batch[c].to_numpy() for c in ("line", "_at", "_end", "_reset"))
            text = np.array(batch["text"].to_pylist(), object)
            code = batch["code"].to_numpy(zero_copy_only=False).astype(np.float64)
            plain = np.isnan(code)
            none = np.iinfo(np.int64).min
            known = np.full(n, none)
            known[1:][plain[:-1]] = line[:-1][plain[:-1]]
            first = line == at
            known[first] = entry[first]
            if not first[0]:
                known[0] = reset
            last = known[np.maximum.accumulate(np.where(known != none, np.arange(n), 0))]
            is_code = ~plain & ((line - last - 1) % 2 == 0)
            after = np.append(text[1:], None)
            after[line == end] = np.array(batch["_next"].to_pylist(), object)[line == end]
            done = n if line[-1] == end[-1] else n - 1
            # the code line before each line: the line above, at a split's start the split's own
            role = np.append([before], np.where(is_code[:-1], code[:-1], np.nan))
            for i in np.flatnonzero(first):
                role[i] = np.nan
                b = batch["_before"][int(i)].as_py()
                if b is not None and (line[i] - 1 - entry[i] - 1) % 2 == 0 and line[i] - 1 != entry[i]:
                    role[i] = float(re.match(r"\s*([+-]?\d+)", b)[1])
            out = text.copy()
            for c in old:
                asked = is_code & (code == c)
                found = pc.index_in(pa.array(after[asked], pa.string()), old[c])
                hit = np.flatnonzero(asked)[found.is_valid().to_numpy(zero_copy_only=False)]
                out[hit] = f"{c:>3}"
                values = np.asarray(role == c)
                found = pc.index_in(pa.array(text[values], pa.string()), old[c])
                valid = found.is_valid().to_numpy(zero_copy_only=False)
                out[np.flatnonzero(values)[valid]] = new[c][
                    found.drop_null().to_numpy(zero_copy_only=False)]
            ending = np.array(batch["ending"].to_pylist(), object)
            files, blocks = batch["file"], batch["block"].to_numpy()
            starts = np.append(np.flatnonzero(first[:done] | (np.arange(done) == 0)), done)
            opened = batch["_open"].to_numpy(zero_copy_only=False)
            lead = batch["_next"].is_null().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(opened & lead & (line == end))
            ending[cut] = [e[:-1] for e in ending[cut]]
            rows = [(files[int(a)].as_py(), f"{blocks[a]:015d}", "".join(
                x for pair in zip(out[a:b], ending[a:b]) for x in pair).encode("latin-1", "replace"))
                for a, b in zip(starts, starts[1:]) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.string(), pa.string(), pa.binary()))], names=["file", "part", "value"])
            held = batch.slice(done) if done < n else None
            if held is not None:
                before = role[done]
                reset = int(last[done])
    return run


def rename_files(
    spark: SparkSession, path, out: str, layer_names: DataFrame | None = None,
    block_names: DataFrame | None = None,
) -> DataFrame:
    """Copy drawings with layers and blocks renamed, every other byte as it was.

    Each file is stored in a folder of its own below ``out``, named by its path below the folder
    that all files share, so files of equal name stay apart; the parts of a folder concatenate to
    the file (see ``parts``).  Line ends, also a missing last one, and empty files are kept; only
    the renamed values and their code lines (padded to three) differ.  A character that Latin-1
    lacks becomes ``?``.  The text is read twice and neither shuffled nor sorted, unless there are
    more names than ``HELD_NAMES``.  Returns the files: file, target.
    """
    listed = list_files(spark, path).select("file")  # a scan leaves empty files out
    targets = materialize(below_common_folder(listed))
    raw = scanned_lines(spark, path).withColumn("code", int_prefix(F.col("text")))
    starts = materialize(_split_starts(raw, whole=True).join(targets.select("file", "target"), "file"))
    few = starts.count() <= HELD_SPLITS
    lines = raw.join(F.broadcast(starts) if few else starts, ["file", "block"]).select(
        F.col("target").alias("file"), "block",
        (F.col("_at") + F.col("_mid") - F.col("_first")).alias("line"), "code", "text", "ending",
        "_at", "_end", "_reset", "_next", "_before", "_open")
    tables = [(t, c) for t, c in ((layer_names, (8, 2)), (block_names, (2,))) if t is not None]
    pairs = [t.select("old", "new").limit(HELD_NAMES + 1).collect() for t, _ in tables]
    held = all(len(p) <= HELD_NAMES for p in pairs)
    names: dict[int, dict[str, str]] = {}
    if held:
        for rows, (_, codes) in zip(pairs, tables):
            for c in codes:
                for r in rows:
                    names.setdefault(c, {}).setdefault(r["old"], r["new"])
    else:
        texts = lines.withColumnRenamed("line", "line_no")
        changed = rename_in_lines(texts, layer_names, block_names)
        lines = changed.withColumnRenamed("line_no", "line").withColumn(
            "code", int_prefix(F.col("text")))
    if not (few and held):
        lines = lines.repartition("file", "block").sortWithinPartitions("file", "line")
    copied = lines.mapInArrow(
        _copy({c: (list(m), list(m.values())) for c, m in names.items()}),
        "file string, part string, value binary")
    empty = targets.join(starts.select("file").distinct(), "file", "left_anti").select(
        F.col("target").alias("file"), F.lit("0" * 15).alias("part"),
        F.lit(b"").alias("value"))
    write_parts(copied.unionByName(empty), out)
    return targets
