"""Merging element tables from many files, conflict handling and bulk edits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterloom.functions.crs import from_lonlat


@dataclass
class MergeResult:
    """``elements`` after the merge, and what happened to every incoming row."""

    elements: DataFrame
    incoming: DataFrame  # incoming rows with ``status``: new, identical, conflict, compatible

    @property
    def conflicts(self) -> DataFrame:
        return self.incoming.where(F.col("status") == "conflict")

    @property
    def skipped(self) -> DataFrame:
        return self.incoming.where(F.col("status") == "identical")


def _all_of(tests: list[Column], default: bool) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(default)) if tests else F.lit(default)


def merge_elements(
    stored: DataFrame, incoming: DataFrame, *, source: str | None = None, id: str = "id",
    keys: list[str] | None = None, order: str = "row_no", source_column: str = "_source",
) -> MergeResult:
    """Add incoming rows to stored ones.

    The base of an identifier is its first stored row, else its first incoming row.  Another
    incoming row of that identifier is skipped when identical, held back as a conflict when a
    field it brings differs, and appended (status ``compatible``) when it only brings less.
    Rows without identifier are appended.  Columns absent from the incoming table are not
    compared; a null is a value.  ``keys`` adds grouping columns such as the element kind.
    """
    keys = keys or []
    group = [*keys, id]
    meta = {*keys, id, order, source_column}
    brought = [c for c in incoming.columns if c not in meta]
    everything = sorted({c for c in stored.columns if c not in meta} | set(brought))
    if source is not None:
        incoming = incoming.withColumn(source_column, F.lit(source))
    types = {**dict(incoming.dtypes), **dict(stored.dtypes)}

    def padded(df: DataFrame) -> DataFrame:
        return df.select(
            *group, order, source_column,
            *[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
              for c in everything],
        )

    old, new = padded(stored), padded(incoming)
    named = F.col(id).isNotNull() & (F.col(id).cast("string") != "")
    row = F.struct(*everything) if everything else F.struct(F.lit(0).alias("_none"))
    # keep only stored identifiers that come in again, then take the first row of each
    touched = new.where(named).select(*group).distinct()
    pool = old.join(touched, group, "left_semi").withColumn("_in", F.lit(0)).unionByName(
        new.where(named).withColumn("_in", F.lit(1))
    )
    base = pool.groupBy(*group).agg(
        F.min_by(F.struct("_in", order, row.alias("_row")), F.struct("_in", order)).alias("_b")
    )
    judged = new.join(base, group, "left")
    same = {c: F.col(c).eqNullSafe(F.col(f"_b._row.{c}")) for c in everything}
    is_base = (F.col("_b._in") == 1) & (F.col(f"_b.{order}") == F.col(order))
    status = (
        F.when(~F.coalesce(named, F.lit(False)) | is_base, "new")
        .when(_all_of(list(same.values()), True), "identical")
        .when(~_all_of([same[c] for c in brought], True), "conflict")
        .otherwise("compatible")
    )
    judged = judged.withColumn("status", status)
    columns = [*group, order, source_column, *everything]
    added = judged.where(F.col("status").isin("new", "compatible")).select(*columns)
    existing = judged.select(*columns, "status", F.col("_b._row").alias("existing"))
    return MergeResult(old.select(*columns).unionByName(added), existing)


def merge_key_values(
    stored: DataFrame, incoming: DataFrame, keys: list[str], value: str = "value",
    order: str = "row_no",
) -> DataFrame:
    """Key/value union in which the last value wins, incoming after stored."""
    both = stored.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(value, F.struct("_in", order)).alias(value))


def resolve_conflicts(
    elements: DataFrame, conflicts: DataFrame, decisions: DataFrame, *, id: str = "id",
    order: str = "row_no", keys: list[str] | None = None, suffix: str = "_new",
) -> DataFrame:
    """Apply one decision per identifier: keep_existing, replace (its first row) or rename.

    ``decisions`` has the identifier and ``resolution``; undecided conflicts change nothing.
    With several conflicts of one identifier the last replaces, and each rename is appended.
    """
    keys = keys or []
    group = [*keys, id]
    decided = conflicts.join(decisions.select(*group, "resolution"), group)
    columns = elements.columns
    others = [c for c in columns if c not in group]
    winner = decided.where(F.col("resolution") == "replace").groupBy(*group).agg(
        F.max_by(F.struct(*others), order).alias("_r")
    )
    first = elements.groupBy(*group).agg(F.min(order).alias("_first"))
    placed = elements.join(winner.join(first, group), group, "left")
    hit = F.col("_r").isNotNull() & (F.col(order) == F.col("_first"))
    replaced = placed.select(*[
        (F.when(hit, F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c)
         if c in others and c != order else F.col(c))
        for c in columns
    ])
    renamed = decided.where(F.col("resolution") == "rename").withColumn(
        id, F.concat(F.col(id).cast("string"), F.lit(suffix))
    ).select(*columns)
    return replaced.unionByName(renamed)


def remove_source(elements: DataFrame, source: str, column: str = "_source") -> DataFrame:
    """Everything that did not come from ``source``."""
    return elements.where(~F.col(column).eqNullSafe(F.lit(source)))


def source_ledger(incoming: DataFrame, kind: str = "kind", source: str = "_source") -> DataFrame:
    """Rows brought per source and kind, skipped and conflicting ones included."""
    return incoming.groupBy(source, kind).agg(F.count(F.lit(1)).alias("n"))


def project_stats(elements: DataFrame, kind: str = "kind", source: str = "_source") -> DataFrame:
    """Rows and number of sources per kind."""
    return elements.groupBy(kind).agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct(source).alias("sources")
    )


def field_differences(
    old: DataFrame, new: DataFrame, key: list[str], columns: list[str] | None = None
) -> DataFrame:
    """One row per key and field whose value differs between two tables."""
    columns = columns or [c for c in old.columns if c not in key and c in new.columns]

    def shaped(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns])
                         .alias(name))

    both = shaped(old, "_o").join(shaped(new, "_n"), key)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"_o.{c}").alias("old"),
                 F.col(f"_n.{c}").alias("new"))
        for c in columns
    ])
    return both.select(*key, F.inline(pairs)).where(~F.col("old").eqNullSafe(F.col("new")))


def concat_tables(tables: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


# ---- edits -------------------------------------------------------------------------------


def change_diameter(
    pipes: DataFrame, old, new, *, diameter: str = "diam", layer: str = "layer"
) -> DataFrame:
    """All pipes of one diameter get another, and the layer named after it."""
    hit = F.coalesce(F.col(diameter) == F.lit(old), F.lit(False))
    kind = dict(pipes.dtypes)[diameter]
    return pipes.withColumns({
        diameter: F.when(hit, F.lit(new).cast(kind)).otherwise(F.col(diameter)),
        layer: F.when(hit, F.concat(F.lit("DN"), F.lit(new).cast("string")))
        .otherwise(F.col(layer)),
    })


def edit_rows(
    table: DataFrame, edits: DataFrame, key: str, *, layer: str | None = None,
    diameter: str = "diam", spaced: bool = False,
) -> DataFrame:
    """Overwrite the columns an edit table brings (null keeps the old value).

    With ``layer`` the layer follows an edited diameter, as ``DNn`` or ``DN n``.
    """
    columns = [c for c in edits.columns if c != key]
    joined = table.join(edits.select(key, *[F.col(c).alias(f"_e_{c}") for c in columns]), key,
                        "left")
    out = {c: F.coalesce(F.col(f"_e_{c}"), F.col(c)) for c in columns}
    if layer and diameter in columns:
        prefix = "DN " if spaced else "DN"
        out[layer] = F.when(
            F.col(f"_e_{diameter}").isNotNull(),
            F.concat(F.lit(prefix), F.col(f"_e_{diameter}").cast("string")),
        ).otherwise(F.col(layer))
    return joined.withColumns(out).select(*table.columns)


def delete_nodes(
    nodes: DataFrame, links: DataFrame, doomed: DataFrame, *, id: str = "id",
    ends: tuple[str, str] = ("node1", "node2"),
) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and every link that touches one of them."""
    gone = doomed.select(id).distinct()
    kept = nodes.join(gone, id, "left_anti")
    for end in ends:
        links = links.join(gone.withColumnRenamed(id, end), end, "left_anti").select(*links.columns)
    return kept, links


def add_nodes(
    nodes: DataFrame, clicks: DataFrame, code: str = "EPSG:32631", id: str = "id"
) -> DataFrame:
    """Append nodes given by longitude and latitude."""
    placed = clicks.withColumn("_p", from_lonlat(F.col("lon"), F.col("lat"), code)).withColumns(
        {"x": F.col("_p.x"), "y": F.col("_p.y")}
    ).drop("_p", "lon", "lat")
    return nodes.unionByName(placed, allowMissingColumns=True)


def add_links(
    links: DataFrame, pairs: DataFrame, nodes: DataFrame, *, id: str = "id",
    ends: tuple[str, str] = ("from_node", "to_node"),
) -> DataFrame:
    """Append links between two known nodes with the default diameter and material."""
    a = nodes.select(F.col(id).alias(ends[0]), F.struct("x", "y").alias("start"))
    b = nodes.select(F.col(id).alias(ends[1]), F.struct("x", "y").alias("end"))
    fresh = pairs.where(F.col(ends[0]) != F.col(ends[1])).join(a, ends[0]).join(b, ends[1])
    fresh = fresh.withColumns({
        "diam": F.lit(315), "material": F.lit("PVC"), "length_m": F.lit(0.0),
        "slope_pct": F.lit(0.0),
    })
    return links.unionByName(fresh, allowMissingColumns=True)


def edited_link_ends(
    links: DataFrame, nodes: DataFrame, id: str = "id",
    ends: tuple[str, str] = ("from_node", "to_node"),
) -> DataFrame:
    """Links with both end positions; links with an unknown end are dropped."""
    a = nodes.select(F.col(id).alias(ends[0]), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col(id).alias(ends[1]), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return links.join(a, ends[0]).join(b, ends[1])


def preview(table: DataFrame, by: list[str], order: str = "row_no", rows: int = 8) -> DataFrame:
    """First rows per file."""
    if not by:
        return table.orderBy(order).limit(rows)
    w = Window.partitionBy(*by).orderBy(order)
    return table.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows).drop("_n")
