"""Bring the diameters of a hydraulic model back into a drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterloom.functions.labels import block_for_diameter, layer_for_diameter
from waterloom.functions.numbers import round_half_up
from waterloom.operators import graph, spatial
from waterloom.operators.ordered import Sequence, first_to_reach_mode
from waterloom.session import materialize


def _matched(points: DataFrame, junctions: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Nearest model junction per point; junctions at the origin are not placed."""
    placed = junctions.where((F.col("x") != 0) | (F.col("y") != 0)).select(
        F.col("id").alias("junction"), F.col("row_no").alias("o"), "x", "y")
    return spatial.nearest(points, placed, probe_key=key, point_key="junction", order="o",
                           radius=tolerance)


def pipe_diameters(
    vertices: DataFrame, junctions: DataFrame, pipes: DataFrame, tolerance: float = 1.0,
    keys: list[str] | None = None, fallback: bool = True,
) -> DataFrame:
    """New diameter per drawn pipe: the commonest of the model pipes along it.

    With ``fallback`` a pipe without one takes that of the first model pipe at its first
    matched vertex.
    """
    keys = keys or ["ent_no"]
    corners = vertices.withColumn("corner", F.struct(*keys, "v_no"))
    hits = _matched(corners, junctions, "corner", tolerance).select("corner", "junction")
    # written, and never broadcast: a row a vertex, read three times below
    at = materialize(corners.hint("merge").join(hits, "corner", "left").select(
        *keys, "v_no", "junction"))
    pairs = Sequence(at, keys, "v_no").following(next=F.col("junction")).df.dropna(
        subset=["junction", "next"])
    links = pipes.select(F.col("node1"), F.col("node2"), F.col("row_no").alias("link_no"),
                         "diameter")
    along = graph.links_between(pairs.hint("merge"), links, a="junction", b="next")
    sizes = along.withColumn("size", round_half_up(F.col("diameter")).cast("bigint"))
    best = first_to_reach_mode(sizes, keys, "size", ["v_no", "link_no"], "diameter")
    if not fallback:
        return best
    ends = graph.incident_links(links, ["link_no", "diameter"])
    first_link = ends.groupBy(F.col("node").alias("junction")).agg(
        F.min_by("diameter", "link_no").alias("_d"))
    spare = at.hint("merge").join(first_link, "junction").groupBy(*keys).agg(
        round_half_up(F.min_by("_d", "v_no")).cast("bigint").alias("_d"))
    return spare.hint("merge").join(best, keys, "full").select(
        *keys, F.coalesce("diameter", "_d").alias("diameter"))


def update_pipes(
    heads: DataFrame, diameters: DataFrame, keys: list[str] | None = None, spaced: bool = False
) -> DataFrame:
    """Pipes with the new diameter and layer; ``spaced`` always writes ``DN n``."""
    keys = keys or ["ent_no"]
    new = F.col("diameter").cast("string")
    layer = F.concat(F.lit("DN "), new) if spaced else layer_for_diameter(F.col("layer"), new)
    joined = heads.join(diameters.select(*keys, "diameter"), keys, "left")
    return joined.withColumns({
        "old_layer": F.col("layer"),
        "layer": F.when(new.isNotNull(), layer).otherwise(F.col("layer")),
        "diam": F.coalesce(new, F.col("diam").cast("string")),
    }).drop("diameter")


def update_nodes(
    nodes: DataFrame, junctions: DataFrame, pipes: DataFrame, valves: DataFrame,
    tolerance: float = 1.0, key: str = "ent_no",
) -> DataFrame:
    """Nodes with the block of their valve's diameter, else of the mean pipe diameter."""
    hits = _matched(nodes, junctions, key, tolerance).select(key, "junction")
    valve = valves.groupBy(F.col("node").alias("junction")).agg(
        F.max_by("diameter", "row_no").alias("_v"))
    ends = graph.incident_links(pipes, ["diameter"])
    mean = ends.groupBy(F.col("node").alias("junction")).agg(
        round_half_up(F.avg("diameter")).cast("bigint").alias("_m"))
    joined = nodes.join(hits, key, "left").join(valve, "junction", "left").join(
        mean, "junction", "left")
    block = F.col("block_name")
    by_valve = block_for_diameter(
        F.when(F.coalesce(block, F.lit("")) == "", "VanneDN40").otherwise(block),
        round_half_up(F.col("_v")).cast("bigint"))
    new = F.when(F.col("_v") > 0, by_valve).when(
        F.col("_m").isNotNull() & block.rlike("(?i)DN"), block_for_diameter(block, F.col("_m"))
    ).otherwise(block)
    return joined.withColumns({"old_block": block, "block_name": new}).drop(
        "junction", "_v", "_m")


def rename_table(updated: DataFrame, old: str, new: str, order: str = "ent_no") -> DataFrame:
    """Old name -> new name; of several new names the last wins."""
    changed = updated.where(
        (F.coalesce(old, F.lit("")) != "") & (F.coalesce(new, F.lit("")) != "")
        & (F.col(old) != F.col(new)))
    return changed.groupBy(F.col(old).alias("old")).agg(F.max_by(new, order).alias("new"))
