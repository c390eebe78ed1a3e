"""Connected components and link topology on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterloom.session import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1]


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable node per node: columns ``node`` and ``component``.

    Alternating large-star / small-star (Kiveris et al., 2014).  Every step is a minimum per
    node, combined before the shuffle, and a join of the edges with one row per node.  That side
    is written first: joined as an aggregate it would tie the edges to its own partitioning, and
    adaptive execution could not split the edges of a node that has very many.
    """
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    nodes = (
        ends.select(F.explode(F.array(src, dst)).alias("node")).distinct()
    )
    stars = materialize(
        ends.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .distinct()
    )
    before = _signature(stars)
    while True:
        # large star: every higher neighbour of a node moves to the node's lowest neighbour
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        lowest = materialize(lowest.select("b", F.least("b", "m").alias("m")))
        large = stars.join(lowest, "b").select("a", F.col("m").alias("b"))
        large = materialize(large.where(F.col("a") != F.col("b")).distinct())
        # small star: a node and its lower neighbours move to the lowest of them
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(
            F.col("b").alias("a"), F.col("m").alias("b")
        )
        superseded = [stars, lowest, large, low]
        stars = materialize(
            small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        for table in superseded:
            discard(table)
        after = _signature(stars)
        if after == before:
            break
        before = after
    return nodes.join(
        stars.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left"
    ).select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    return labelled.groupBy(*(by or []), "component").agg(F.count(F.lit(1)).alias("nodes"))


def topology_summary(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row, or one per ``by``: number of components, size of the largest, and how many are
    smaller."""
    by = by or []
    by_size = component_sizes(labelled, by).groupBy(*by, "nodes").agg(F.count(F.lit(1)).alias("n"))
    top = by_size.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("components"),
        F.coalesce(F.max("nodes"), F.lit(0)).alias("largest"),
        F.max_by("n", "nodes").alias("_at_top"),
    )
    return top.select(
        *by, "components", "largest",
        (F.col("components") - F.coalesce("_at_top", F.lit(0))).alias("isolated"),
    )


def incident_links(
    links: DataFrame, carried: list[str], node1: str = "node1", node2: str = "node2"
) -> DataFrame:
    """One row per (node, link) for both ends; a link from a node to itself counts twice."""
    return links.select(
        *carried, F.explode(F.array(F.struct(F.col(node1).alias("node"), F.lit(1).alias("end")),
                                    F.struct(F.col(node2).alias("node"), F.lit(2).alias("end"))))
        .alias("_e"),
    ).select(*carried, F.col("_e.node").alias("node"), F.col("_e.end").alias("end"))


def links_between(
    pairs: DataFrame, links: DataFrame, *, a: str = "a", b: str = "b", node1: str = "node1",
    node2: str = "node2", by: list[str] | None = None,
) -> DataFrame:
    """Join node pairs with the links that connect them in either direction.

    A pair of equal nodes meets every link of that node, once per end it touches, as a link list
    kept per node does.
    """
    by = by or []
    lo, hi = F.least(a, b), F.greatest(a, b)
    keyed = links.withColumns({"_lo": F.least(node1, node2), "_hi": F.greatest(node1, node2)})
    apart = pairs.where(F.col(a) != F.col(b)).withColumns({"_lo": lo, "_hi": hi})
    joined = apart.join(keyed, [*by, "_lo", "_hi"]).drop("_lo", "_hi")
    ends = keyed.drop("_lo", "_hi").withColumn("_n", F.explode(F.array(node1, node2)))
    loops = pairs.where(F.col(a) == F.col(b)).withColumn("_n", F.col(a)).join(ends, [*by, "_n"])
    return joined.unionByName(loops.drop("_n"))
