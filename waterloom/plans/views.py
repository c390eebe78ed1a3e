"""Tables as a user sees them: counts per family, distinct diameters, ranks, acceptance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterloom.functions.numbers import float_prefix
from waterloom.operators.detect import ACCEPT_COLUMN, AUTO_ACCEPT, PRESELECT_TYPE
from waterloom.operators.ordered import Sequence
from waterloom.operators.validate import LINK_TABLES, NODE_TABLES, reference_findings


def distinct_diameters(pipes: DataFrame, diameter: str = "diam") -> DataFrame:
    """Distinct non-empty diameters with their number of pipes; ``place`` is the numeric order.

    Texts that do not start with a number come last, in text order.  The distinct values are
    numbered by slices when they are too many for one task.
    """
    text = F.trim(F.col(diameter).cast("string"))
    counts = pipes.where(F.coalesce(text, F.lit("")) != "").groupBy(text.alias("diameter")).agg(
        F.count(F.lit(1)).alias("pipes"))
    size = float_prefix(F.col("diameter"))
    ranked_ = counts.withColumns({"_none": size.isNull(), "_size": size})
    return Sequence(ranked_, [], ["_none", "_size", "diameter"]).row_number("place").df.select(
        "diameter", "pipes", "place")


def family_counts(families: dict[str, DataFrame], named: dict[str, Column] | None = None,
                  by: list[str] | None = None) -> DataFrame:
    """Per family: rows, and rows that have what its badge shows (a size, a name)."""
    named = named or {}
    frames = [df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(named.get(name, F.lit(True)), F.lit(False))).alias("marked"),
    ).withColumn("family", F.lit(name)) for name, df in families.items()]
    return reduce(DataFrame.unionByName, frames)


def ranked(scores: DataFrame, by: list[str], score: str = "score", place: str = "place"
           ) -> DataFrame:
    """All candidates of a header from the best score down, the earlier place first of equals."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(place))
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint"))


def acceptance(confidence: Column) -> Column:
    """``auto`` if a table is mapped unasked, ``preselected`` if its type is also chosen
    beforehand, else ``ask``."""
    return F.when(confidence >= PRESELECT_TYPE, "preselected").when(
        confidence >= AUTO_ACCEPT, "auto").otherwise("ask")


def accepted_columns(suggestions: DataFrame, score: str = "score") -> DataFrame:
    """Suggestions that are good enough to be applied column by column."""
    return suggestions.where(F.col(score) >= ACCEPT_COLUMN)


def anchored_vertices(corners: DataFrame, on_node: DataFrame, key: list[str]) -> DataFrame:
    """Per polyline: vertices, and vertices that lie on a node block."""
    hit = on_node.select(*key, F.col("corner.v_no").alias("v_no")).distinct().withColumn(
        "_hit", F.lit(1))
    return corners.join(hit, [*key, "v_no"], "left").groupBy(*key).agg(
        F.count(F.lit(1)).alias("vertices"), F.count("_hit").alias("anchored"))


def reference_summary(tables: dict[str, DataFrame], row_no: str = "row_no") -> DataFrame:
    """One row beside the findings: nodes, links, errors of each kind, and the warning when links
    stand without any node table."""
    def rows(names):
        frames = [tables[n].select(F.lit(1).alias("_")) for n in names if n in tables]
        if not frames:
            return None
        return reduce(DataFrame.unionByName, frames).agg(F.count(F.lit(1)).alias("n"))

    nodes, links = rows(NODE_TABLES), rows(LINK_TABLES)
    found = reference_findings(tables, row_no).agg(
        F.count_if(F.col("type") == "missing_ref").alias("missing_refs"),
        F.count_if(F.col("type") == "duplicate_id").alias("duplicates"))
    for name, counted in (("nodes", nodes), ("links", links)):
        found = found.withColumn(name, F.lit(0).cast("bigint")) if counted is None else (
            # both sides are single-row aggregates
            found.withColumn("_k", F.lit(1)).join(
                counted.select(F.col("n").alias(name), F.lit(1).alias("_k")), "_k").drop("_k"))
    return found.select("nodes", "links", "missing_refs", "duplicates", F.when(
        F.col("nodes") == 0, "No nodes found").alias("warning"))
