"""Map features: one row per feature, written as GeoJSON lines or Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterloom.functions.crs import to_lonlat
from waterloom.functions.numbers import float_prefix, int_prefix, or_default, round_half_up
from waterloom.operators import polylines, spatial
from waterloom.plans.drawing import Drawing
from waterloom.sources import proxy

COLUMNS = ["file", "type", "geometry", "coordinates", "properties"]


def _lonlat(x: str, y: str, code: str) -> Column:
    # bound, so that the position is computed once for its two numbers
    spot = F.array(to_lonlat(F.col(x), F.col(y), code))
    return F.transform(spot, lambda s: F.array(s["lon"], s["lat"]))[0]


def _row(df: DataFrame, kind: str, geometry: str, properties: dict[str, Column]) -> DataFrame:
    values = [c.alias(n) for n, c in properties.items()] or [F.lit(None).alias("none")]
    return df.select(
        "file", F.lit(kind).alias("type"), F.lit(geometry).alias("geometry"), "coordinates",
        F.to_json(F.struct(*values)).alias("properties"))


def point_features(
    df: DataFrame, kind: str, code: str, properties: dict[str, Column] | None = None,
    x: str = "x", y: str = "y",
) -> DataFrame:
    """Point features; ``coordinates`` holds one position."""
    placed = df.withColumn("coordinates", F.array(_lonlat(x, y, code)))
    return _row(placed, kind, "Point", properties or {})


def segment_features(df: DataFrame, kind: str, code: str, properties=None) -> DataFrame:
    placed = df.withColumn(
        "coordinates", F.array(_lonlat("x1", "y1", code), _lonlat("x2", "y2", code)))
    return _row(placed, kind, "LineString", properties or {})


def line_features(
    df: DataFrame, vertices: DataFrame, kind: str, code: str, properties=None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Line features.  A GeoJSON line is one value, so its positions are gathered here only."""
    keys = keys or ["file", "ent_no"]
    wanted = vertices.join(df.select(*keys), keys, "left_semi")
    spots = wanted.select(*keys, "v_no", _lonlat("x", "y", code).alias("c"))
    lines = spots.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("v_no", "c"))), lambda s: s["c"]).alias("coordinates"))
    return _row(df.join(lines, keys), kind, "LineString", properties or {})


def labelled_pipes(d: Drawing, code: str) -> DataFrame:
    """Pipe labels on the first plan pipe whose mean vertex is within 100 in x and y."""
    named = d.pipe_labels.withColumnRenamed("ent_no", "label_no")
    means = d.plan_pipes.select("file", F.col("ent_no").alias("pipe_no"),
                                F.col("ent_no").alias("o"), F.col("mean_x").alias("x"),
                                F.col("mean_y").alias("y"))
    found = spatial.first_around(named, means, probe_key="label_no", point_key="pipe_no",
                                 order="o", half=100.0, by=["file"])
    placed = named.join(found, ["file", "label_no"], "left")
    props = {
        "diam_mm": F.coalesce(int_prefix(F.col("diam")), F.lit(0)),
        "longueur": F.coalesce(float_prefix(F.col("length")), F.lit(0.0)),
        "pente_pct": F.coalesce(float_prefix(F.col("slope")), F.lit(0.0)),
        "direction": F.col("dir"), "materiau": F.col("material")}
    on_pipe = placed.where(F.col("pipe_no").isNotNull())
    lines = d.plan_vertices.withColumnRenamed("ent_no", "pipe_no").join(
        on_pipe.select("file", "pipe_no", "label_no"), ["file", "pipe_no"])
    with_line = line_features(on_pipe, lines, "pipe", code, props, ["file", "label_no"])
    alone = placed.where(F.col("pipe_no").isNull()).withColumn(
        "coordinates", F.array(_lonlat("x", "y", code)))
    return with_line.unionByName(_row(alone, "pipe", "LineString", props))


def drawing_features(d: Drawing, code: str = "EPSG:32631", for_map: bool = False) -> DataFrame:
    """All families of a drawing; ``for_map`` adds profile, plan and extra-node features."""
    v, size = d.vertices, {"diam_mm": F.coalesce(int_prefix(F.col("diam")), F.lit(0)),
                           "calque": F.col("layer")}
    m = d.enriched_manholes
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    measured = {n: F.coalesce(float_prefix(F.col(n)), F.lit(0.0)) for n in ("ct", "cr", "pp")}
    if for_map:
        props = {"id": F.col("id"), "profileId": F.coalesce("profile_id", F.lit("")),
                 "profileInvert": zero("profile_invert"), "profileDepth": zero("profile_depth"),
                 "profileGround": zero("profile_ground"), "profileCumul": zero("profile_cumul"),
                 **measured}
    else:
        prefer = lambda c, n: or_default(F.col(c), measured[n])
        props = {"id": F.coalesce(F.nullif("profile_id", F.lit("")), "id"),
                 "ct": prefer("profile_ground", "ct"), "cr": prefer("profile_invert", "cr"),
                 "pp": prefer("profile_depth", "pp"), "cumul": zero("profile_cumul")}
    block = {"block": F.col("block_name")}
    turned = {**block, "rotation": F.col("rotation")} if for_map else block
    frames = [
        line_features(d.dn_pipes, v, "pipe_dn", code, size),
        point_features(m, "regard", code, props),
        point_features(d.second_nodes, "assai_noeud", code, {"rotation": F.col("rotation")}),
        segment_features(d.second_lines, "assai_tuyau", code, size),
        line_features(d.supply_pipes, v, "aep_pipe", code, size),
        point_features(d.supply_nodes, "aep_noeud", code, turned),
        line_features(d.supply_splines, v, "aep_spline", code),
        line_features(d.fire_pipes, v, "incendie_pipe", code),
        point_features(d.fire_nodes, "incendie_noeud", code,
                       {"id": F.col("id"), **block} if for_map else block),
        line_features(d.projected, v, "reseau_projete", code),
    ]
    if for_map:
        plan = d.annotated_pipes.where(F.col("profile_idx") < 0)
        frames += [
            segment_features(d.profile_segments, "pipe_profile", code, {
                "fromNode": F.col("from_node"), "toNode": F.col("to_node"),
                "diam_mm": F.col("diam"), "materiau": F.col("material"),
                "longueur": F.col("length_m"), "pente_pct": F.col("slope_pct")}),
            line_features(plan.where(F.col("diam") <= 0), v, "pipe_plan", code),
            line_features(plan.where(F.col("diam") > 0), v, "pipe_label", code, {
                "diam_mm": F.col("diam"), "materiau": F.col("material"),
                "longueur_totale": F.col("label_length"), "pente": F.col("label_slope")}),
            point_features(d.extra_nodes, "new_eu1_noeud", code, turned),
        ]
    else:
        frames.insert(0, labelled_pipes(d, code))
    return reduce(DataFrame.unionByName, frames)


def proxy_network(blobs: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """Pipes (long vertices), structures, labels and blocks of proxy drawings.

    Of several polylines or texts of one entity the last counts.
    """
    subs = proxy.decode_proxies(blobs)
    keys = ["file", "ent_no", "handle", "network", "layer"]
    last = subs.groupBy(*keys).agg(
        F.max_by("vertices", F.when(F.col("kind") == "POLYLINE", F.col("sub_no"))).alias("line"),
        F.max_by(F.struct("x", "y", "text"),
                 F.when(F.col("kind") == "TEXT", F.col("sub_no"))).alias("label"))
    pipes = last.where(F.col("layer").endswith("-PIPE") & (F.size("line") >= 2))
    vertices = pipes.select("file", "ent_no", F.posexplode("line").alias("v_no", "_p")).select(
        "file", "ent_no", (F.col("v_no") + 1).cast("bigint").alias("v_no"), "_p.*")
    measured = polylines.lengths(vertices, ["file", "ent_no"]).select(
        "file", "ent_no", round_half_up(F.col("length"), 2).alias("length_m"))
    spot = F.coalesce(F.try_element_at("line", F.lit(1)), F.struct("label.x", "label.y"))
    return {
        "pipes": pipes.select(*keys).join(measured, ["file", "ent_no"]),
        "vertices": vertices,
        "structures": last.where(F.col("layer").endswith("-STRC")).withColumn("_s", spot).where(
            F.col("_s.x").isNotNull()).select(*keys, "_s.x", "_s.y"),
        "labels": last.where(F.col("layer").endswith("-TEXT") & F.col("label").isNotNull()).select(
            *keys, "label.x", "label.y", "label.text"),
        "blocks": blocks,
        "errors": subs.where(F.col("kind") == "ERROR").select(*keys, "sub_no", "error"),
    }


def proxy_features(net: dict[str, DataFrame], code: str = "EPSG:32631") -> DataFrame:
    c = F.col
    return reduce(DataFrame.unionByName, [
        line_features(net["pipes"], net["vertices"], "civil3d_pipe", code, {
            "network": c("network"), "handle": c("handle"), "length_m": c("length_m"),
            "layer": c("layer")}),
        point_features(net["structures"], "civil3d_structure", code, {
            "network": c("network"), "handle": c("handle"), "layer": c("layer")}),
        point_features(net["labels"], "civil3d_label", code, {
            "text": c("text"), "handle": c("handle"), "layer": c("layer")}),
        point_features(net["blocks"], "civil3d_block", code, {
            "block": c("block_name"), "layer": c("layer")}),
    ])


def feature_json(features: DataFrame) -> DataFrame:
    """One GeoJSON Feature per row, ``type`` first in its properties."""
    shape = F.when(F.col("geometry") == "Point", F.to_json(F.element_at("coordinates", 1))).otherwise(
        F.to_json("coordinates"))
    rest = F.regexp_replace("properties", r"^\{", "")
    tail = F.when(rest == "}", rest).otherwise(F.concat(F.lit(","), rest))
    return features.select("file", "type", F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"'), "geometry",
        F.lit('","coordinates":'), shape, F.lit('},"properties":{"type":"'), "type", F.lit('"'),
        tail, F.lit("}")).alias("value"))


def write_features(features: DataFrame, path: str, fmt: str = "geojsonl") -> None:
    """GeoJSON lines or Parquet, one folder per feature type."""
    if fmt == "parquet":
        features.write.partitionBy("type").parquet(path)
    else:
        feature_json(features).select("type", "value").write.partitionBy("type").text(path)


def features_of(features: DataFrame, kind: str) -> DataFrame:
    return features.where(F.col("type") == kind)


def extent(features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bounding box of all positions."""
    spots = features.select(*(by or []), F.explode("coordinates").alias("c"))
    lon, lat = F.element_at("c", 1), F.element_at("c", 2)
    return spots.groupBy(*(by or [])).agg(
        F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"),
        F.max(lat).alias("north"))


def badge_counts(d: Drawing) -> DataFrame:
    """Per file: sized pipes of all, named manholes of all."""
    pipes = d.annotated_pipes.groupBy("file").agg(
        F.count_if(F.col("diam") > 0).alias("sized"), F.count(F.lit(1)).alias("pipes"))
    named = (F.coalesce("profile_id", F.lit("")) != "") | (F.col("id") != "R?")
    people = d.enriched_manholes.groupBy("file").agg(
        F.count_if(named).alias("named"), F.count(F.lit(1)).alias("manholes"))
    return pipes.join(people, "file", "full").na.fill(0)
