"""Element tables out of mapped CSV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterloom import schema
from waterloom.functions.numbers import number, text_or, trim
from waterloom.operators.ordered import Sequence
from waterloom.operators.profiling import junk_columns
from waterloom.session import materialize
from waterloom.sources.csvfiles import cells_of

# Prefix of generated identifiers.
ID_PREFIX = {"JUNCTIONS": "J", "PIPES": "P", "RESERVOIRS": "R", "TANKS": "T", "PUMPS": "PU",
             "VALVES": "V"}
_DEFAULTS = {"status": "Open", "type": "PRV"}
_LINKS = {"PIPES", "PUMPS", "VALVES"}


def map_table(
    rows: DataFrame, mapping: DataFrame, section: str, *, strict_coordinates: bool = True,
    comments: bool = True,
) -> dict[str, DataFrame]:
    """Typed rows of one section and their coordinates.

    ``rows`` are (file, row_no, headers, cells) as the CSV reader gives them; ``mapping`` is
    (file, header, field), a few rows per file, so cells are picked by place inside their row
    and never shuffled.  Unmapped filled cells of columns that are not junk become the comment.
    With ``strict_coordinates`` a position counts only when both parts are non-zero and only for
    junctions; otherwise when both are present, for reservoirs and tanks too.
    """
    chosen = mapping.where(F.col("field").isNotNull()).groupBy("file", "field").agg(
        F.max(F.lower("header")).alias("_h")
    ).groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "_h"))).alias("_map"))
    long = rows.where(F.col("row_no") > 0).join(chosen, "file", "left")
    lower = F.transform("headers", F.lower)

    def get(name: str) -> Column:
        at = F.array_position(lower, F.element_at("_map", F.lit(name))).cast("int")
        return F.coalesce(
            F.when(at > 0, F.try_element_at(F.col("cells"), at)), F.lit("")).alias(name)

    fields = list(dict.fromkeys(schema.all_fields(section) + ["x", "y"]))
    parts = [get(f) for f in fields]
    if comments:
        junk = junk_columns(cells_of(rows), ["file", "header"]).groupBy("file").agg(
            F.collect_set("header").alias("_junk"))
        long = long.join(junk, "file", "left")
        used = F.coalesce(F.map_values("_map"), F.array().cast("array<string>"))
        skipped = F.coalesce("_junk", F.array().cast("array<string>"))
        pairs = F.filter(F.arrays_zip(F.col("headers").alias("h"), F.col("cells").alias("c")),
                         lambda p: ~F.array_contains(used, F.lower(p["h"]))
                         & ~F.array_contains(skipped, p["h"]))
        spare = F.transform(pairs, lambda p: trim(F.regexp_replace(
            F.coalesce(p["c"], F.lit("")), ";+$", "")))
        parts.append(F.array_join(F.filter(spare, lambda t: t != ""), " ").alias("comment"))
    keys = ["file", "row_no"]
    kept = long.select(*keys, *parts)

    def num(name: str, default: float = 0.0) -> Column:
        v = F.coalesce(number(F.col(name)), F.lit(0.0))
        return F.when(v == 0, F.lit(default)).otherwise(v)

    columns = []
    for f in schema.all_fields(section):
        if f == "id":
            continue
        if schema.RULES.get(f, {}).get("kind") == "numeric":
            columns.append(num(f, 140.0 if f == "roughness" else 0.0).alias(f))
        else:
            columns.append(text_or(F.col(f), _DEFAULTS.get(f, "")).alias(f))
    if section in _LINKS:
        kept = kept.where((F.col("node1") != "") & (F.col("node2") != ""))
    kept = materialize(kept)
    counted = kept.withColumn("_n", F.lit(None).cast("bigint"))
    if not kept.where(F.col("id") == "").isEmpty():
        # a generated number counts the rows written so far, so the rows have to be numbered
        counted = Sequence(kept, ["file"], "row_no").row_number("_n").df
    id_ = text_or(F.col("id"), F.concat(F.lit(ID_PREFIX[section]), F.col("_n").cast("string")))
    tail = ["comment"] if comments else []
    out = counted.select(*keys, id_.alias("id"), *columns, *tail)
    spots = counted.select(*keys, id_.alias("id"), number(F.nullif("x", F.lit(""))).alias("x"),
                           number(F.nullif("y", F.lit(""))).alias("y")).dropna(subset=["x", "y"])
    if strict_coordinates:
        spots = spots.where((F.col("x") != 0) & (F.col("y") != 0))
    placed = section == "JUNCTIONS" or (
        not strict_coordinates and section in ("RESERVOIRS", "TANKS"))
    return {section.lower(): out, "coordinates": spots if placed else spots.where(F.lit(False))}


def positional_mapping(rows: DataFrame, section: str) -> DataFrame:
    """Mapping by column place, for files whose headers say nothing."""
    names = F.array(*[F.lit(f) for f in schema.POSITIONAL[section]])
    heads = rows.where(F.col("row_no") == 0).select("file", F.posexplode("headers"))
    return heads.select(
        "file", F.col("col").alias("header"),
        F.try_element_at(names, F.col("pos") + 1).alias("field"),
    ).where(F.col("field").isNotNull())
