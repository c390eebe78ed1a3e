"""Sewer, supply and fire networks out of drawing entities.

Every frame is keyed by ``file``, so a batch of drawings is one job.  ``ent_no`` is the place of
an entity in its file and decides every tie.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterloom.functions import labels
from waterloom.functions.geometry import geometry_class
from waterloom.functions.numbers import (
    float_prefix,
    int_prefix,
    number,
    or_default,
    round_half_up,
    to_fixed,
    trim,
)
from waterloom.operators import matching, polylines, spatial
from waterloom.operators.ordered import Sequence, encounter_ids
from waterloom.session import materialize
from waterloom.sources import dxf

# Layers of each family.
MAIN, MAIN_TEXT = "EU 1_Canalisations", "EU 1_Canalisations_Habillage"
NODES, NODE_TEXT = "EU 1_Regards", "EU 1_Regards_Habillage"
SECOND_NODES, SECOND_LINES = "assai", {"assai 250": "250", "pvc 200": "200"}
EXTRA_NODES = "New_EU 1_Canalisations_Pen_No__14"
PROJECTED = "assainissement"
SUPPLY_PIPES = ["DN 90", "DN110", "DN160", "DN200", "DN400", "DN500", "MA-P14-pipe 63", "DN 63"]
SUPPLY, FIRE = "_AEP", "_RESEAU INCENDIE"
# Search radii.
LABEL_RADIUS, GROUP_RADIUS, NODE_RADIUS, FILL_RADIUS, SNAP_RADIUS = 300.0, 5.0, 50.0, 200.0, 0.5
ANCHOR_RADIUS, END_RADIUS = 2.0, 999.0

_KEY = ["file", "ent_no"]


@dataclass
class Drawing:
    """Entities and long vertices of a batch of drawings, and the networks found in them.

    ``unique_pipe`` uses each pipe for one profile at most and each node once per profile (the
    interactive rules); without it several profiles may share a pipe (the batch rules).
    """

    entities: DataFrame
    vertices: DataFrame
    unique_pipe: bool = True

    @classmethod
    def from_tags(cls, marked: DataFrame, unique_pipe: bool = True) -> "Drawing":
        """Assemble entities and vertices once; every network below reads the written tables."""
        kept = materialize(dxf.model_space(marked, [*dxf.ENTITY_TYPES, "SPLINE"]))
        return cls(materialize(dxf.entities(kept)), materialize(dxf.vertices(kept)), unique_pipe)

    @classmethod
    def read(cls, spark: SparkSession, path, unique_pipe: bool = True) -> "Drawing":
        tags = materialize(dxf.read_tags(spark, path))
        return cls.from_tags(dxf.mark_entities(tags), unique_pipe)

    def of(self, kind: str, layer: Column) -> DataFrame:
        return self.entities.where((F.col("type") == kind) & layer)

    def shapes(self, layer: Column, least: int = 2) -> DataFrame:
        """Polylines of a layer with their box; short ones are dropped."""
        found = self.of("LWPOLYLINE", layer).select(*_KEY, "layer", "closed")
        return found.join(self.boxes, _KEY).where(F.col("vertices") >= least)

    @cached_property
    def boxes(self) -> DataFrame:
        return materialize(polylines.boxes(self.vertices, _KEY))

    @cached_property
    def strict(self) -> DataFrame:
        main = self.of("LWPOLYLINE", F.col("layer") == MAIN).select(*_KEY)
        return materialize(
            polylines.coordinate_mode(self.vertices.join(main, _KEY, "left_semi"), ["file"]))

    def with_mode(self, df: DataFrame) -> DataFrame:
        return df.join(self.strict, "file", "left").withColumn(
            "strict", F.coalesce("strict", F.lit(False))
        )

    def in_plan(self, df: DataFrame, x: str = "x", y: str | None = "y") -> DataFrame:
        """Drop rows outside the plan area where the file is in plan coordinates."""
        inside = F.col(x) > 500000
        if y:
            inside = inside & (F.col(y) > 2000000)
        return self.with_mode(df).where(~F.col("strict") | inside).drop("strict")

    # ---- pipes --------------------------------------------------------------------------

    @cached_property
    def classified(self) -> DataFrame:
        """Main-layer polylines with their class and length."""
        shaped = materialize(self.with_mode(self.shapes(F.col("layer") == MAIN)))
        kind = geometry_class(F.col("strict"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
        measured = polylines.lengths(
            self.vertices.join(shaped.select(*_KEY), _KEY, "left_semi"), _KEY
        ).select(*_KEY, "length")
        return materialize(shaped.withColumn("class", kind).join(measured, _KEY))

    @property
    def plan_pipes(self) -> DataFrame:
        return self.classified.where(F.col("class") == "pipe")

    @property
    def plan_vertices(self) -> DataFrame:
        return self.vertices.join(self.plan_pipes.select(*_KEY), _KEY, "left_semi")

    @property
    def dn_pipes(self) -> DataFrame:
        found = self.shapes(F.col("layer").rlike(r"(?i)^DN\s+\d+$"), least=0)
        return found.withColumn("diam", F.regexp_extract("layer", r"(?i)DN\s+(\d+)", 1))

    @property
    def supply_pipes(self) -> DataFrame:
        found = self.in_plan(self.shapes(F.col("layer").isin(SUPPLY_PIPES)), "mean_x", None)
        return found.withColumn("diam", labels.layer_diameter(F.col("layer")))

    @property
    def fire_pipes(self) -> DataFrame:
        return self.shapes(F.col("layer") == FIRE)

    @property
    def projected(self) -> DataFrame:
        return self.shapes(F.col("layer").contains(PROJECTED), least=0)

    @property
    def second_lines(self) -> DataFrame:
        found = self.in_plan(self.of("LINE", F.col("layer").isin(list(SECOND_LINES))), "x", None)
        size = F.create_map(*[F.lit(v) for kv in SECOND_LINES.items() for v in kv])
        return found.dropna(subset=["x", "x2"]).select(
            *_KEY, "layer", F.element_at(size, F.col("layer")).alias("diam"), F.col("x").alias("x1"),
            F.col("y").alias("y1"), "x2", "y2")

    # ---- nodes --------------------------------------------------------------------------

    def inserts(self, layer: str, plan: bool = True) -> DataFrame:
        found = self.of("INSERT", F.col("layer") == layer).select(
            *_KEY, "x", "y", "block_name", "rotation")
        return self.in_plan(found) if plan else found

    @property
    def second_nodes(self) -> DataFrame:
        return self.inserts(SECOND_NODES)

    @property
    def extra_nodes(self) -> DataFrame:
        return self.inserts(EXTRA_NODES)

    @property
    def supply_nodes(self) -> DataFrame:
        return self.inserts(SUPPLY)

    @property
    def supply_splines(self) -> DataFrame:
        found = self.of("SPLINE", F.col("layer") == SUPPLY).select(*_KEY, "degree")
        return found.join(self.boxes.where(F.col("vertices") >= 2), _KEY)

    @property
    def fire_nodes(self) -> DataFrame:
        found = self.inserts(FIRE)
        ids = encounter_ids(found, ["ent_no"], ["ent_no"], "Incendie", within=["file"])
        return found.join(ids.select(*_KEY, "id"), _KEY)

    # ---- labels -------------------------------------------------------------------------

    @cached_property
    def label_groups(self) -> DataFrame:
        """Size and slope texts clustered around the first free text."""
        texts = self.of("TEXT", F.col("layer") == MAIN_TEXT).select(
            *_KEY, trim(F.col("text")).alias("text"), "x", "y")
        led = matching.leader_cluster(texts, key="ent_no", order="ent_no", radius=GROUP_RADIUS,
                                      by=["file"])
        rows = texts.join(led, _KEY).withColumns({
            "_size": labels.size_label(F.col("text")), "_slope": labels.slope_label(F.col("text"))})
        place = F.col("ent_no")
        return materialize(rows.groupBy("file", "leader").agg(
            F.max_by("_size", F.when(F.col("_size").isNotNull(), place)).alias("_size"),
            F.max_by("_slope", F.when(F.col("_slope").isNotNull(), place)).alias("_slope"),
            F.min_by(F.struct("x", "y"), place).alias("_p"), F.avg("x").alias("mean_x"),
            F.avg("y").alias("mean_y"), F.count(F.lit(1)).alias("texts"),
        ).select(
            "file", F.col("leader").alias("ent_no"), "_size.material", "_size.diam",
            "_size.length", "_slope.slope", "_slope.dir", F.col("_p.x").alias("x"),
            F.col("_p.y").alias("y"), "mean_x", "mean_y", "texts"))

    @property
    def pipe_labels(self) -> DataFrame:
        """Label groups of at least two texts that name a diameter."""
        return self.label_groups.where((F.col("texts") > 1) & F.col("diam").isNotNull()).na.fill(
            "", ["slope", "dir"])

    @cached_property
    def manholes(self) -> DataFrame:
        """Node labels matched one to one to node blocks, lower ones first."""
        nodes = matching.priority(
            self.of("INSERT", F.col("layer") == NODES).select("file", "ent_no", "x", "y"),
            ["y", "ent_no"], "turn", by=["file"])
        texts = self.of("MTEXT", F.col("layer") == NODE_TEXT).withColumn(
            "_l", labels.manhole_label(F.col("text"), spaced=self.unique_pipe)
        ).select("file", "ent_no", "_l.*", "x", "y")
        texts = materialize(matching.priority(texts, ["y", "ent_no"], "turn", by=["file"]))
        nodes = materialize(nodes.withColumnRenamed("ent_no", "node_no"))
        pairs = materialize(matching.serial_match(
            texts, nodes, probe_key="ent_no", point_key="node_no", probe_order="turn",
            point_order="turn", radius=LABEL_RADIUS, by=["file"]))
        spots = nodes.select("file", "node_no", F.col("x").alias("_nx"), F.col("y").alias("_ny"))
        labelled = texts.join(pairs, _KEY, "left").join(spots, ["file", "node_no"], "left").select(
            "file", "turn", "id", "ct", "cr", "pp", F.coalesce("_nx", "x").alias("x"),
            F.coalesce("_ny", "y").alias("y"), F.col("node_no").isNotNull().alias("matched"),
            "distance", F.lit(0).alias("part"))
        lonely = nodes.join(pairs, ["file", "node_no"], "left_anti").select(
            "file", "turn", F.lit("R?").alias("id"),
            *[F.lit("").alias(c) for c in ("ct", "cr", "pp")],
            "x", "y", F.lit(False).alias("matched"), F.lit(None).cast("double").alias("distance"),
            F.lit(1).alias("part"))
        return materialize(labelled.unionByName(lonely))

    # ---- profiles -----------------------------------------------------------------------

    @cached_property
    def profile_values(self) -> DataFrame:
        """Profile texts in sections: file, layer, profile_idx, section_no, header, pos, value."""
        texts = self.of("TEXT", F.col("layer").rlike(labels.PROFILE_LAYERS)).select(
            *_KEY, "layer", trim(F.col("text")).alias("value"))
        gathered = polylines.gather_sections(
            texts, ["file", "layer"], labels.profile_header(F.col("value")), "ent_no")
        seen = self.entities.where(F.col("layer").rlike(labels.PROFILE_LAYERS)).groupBy(
            "file", "layer").agg(F.min("ent_no").alias("_first"))
        with_text = seen.join(texts.select("file", "layer"), ["file", "layer"], "left_semi")
        index = Sequence(with_text, ["file"], "_first").row_number("_n").df.select(
            "file", "layer", (F.col("_n") - 1).alias("profile_idx"))
        return materialize(gathered.join(index, ["file", "layer"]))

    def _section(self, prefix: str) -> DataFrame:
        """Values of the first section whose header starts with ``prefix``."""
        hits = self.profile_values.where(F.col("header").startswith(prefix))
        first = hits.groupBy("file", "profile_idx").agg(F.min("section_no").alias("section_no"))
        return hits.join(first, ["file", "profile_idx", "section_no"]).where(~F.col("is_header"))

    @cached_property
    def profiles(self) -> DataFrame:
        """One row per profile: layer, title, end nodes, material, diameter, scales, datum."""
        rows = self.profile_values
        h, at = F.col("header"), F.struct("section_no", "pos")
        sized = h.startswith("Dimensions") | h.startswith("Alignements")
        first_value = ~F.col("is_header") & (F.col("pos") == 0) & (F.col("value") != "")

        def last(test: Column) -> Column:
            return F.max_by("value", F.when(test, at))

        diam = labels.material_diameter(F.col("value"))
        title = last(F.col("is_header") & h.startswith("Profil"))
        named = F.col("is_header") & h.startswith("Profil") & F.col("value").rlike(
            r"noeuds\s+\S+-\S+")
        out = rows.groupBy("file", "profile_idx", "layer").agg(
            title.alias("title"), last(named).alias("_ends"),
            last(sized & first_value).alias("material"),
            F.max_by(diam, F.when(sized & first_value & diam.isNotNull(), at)).alias("diam"),
            last(F.col("is_header") & h.startswith("Echelle en X")).alias("scale_x"),
            last(F.col("is_header") & h.startswith("Echelle en Y")).alias("scale_y"),
            last(F.col("is_header") & h.startswith("PC")).alias("datum"),
        )
        ends = labels.profile_ends(F.coalesce("_ends", F.lit("")))
        return out.withColumn("_e", ends).select(
            "file", "profile_idx", "layer", F.coalesce("title", F.lit("")).alias("title"), "_e.*",
            "material", "diam", "scale_x", "scale_y", "datum")

    @cached_property
    def stations(self) -> DataFrame:
        """Profile stations: cumulative distance with the values at the same place."""
        cumul = self._section("Distances cumulées").withColumn("cumul", number(F.col("value"))).where(
            F.col("cumul").isNotNull())
        keys = ["file", "profile_idx"]
        out = Sequence(cumul.select(*keys, "pos", "cumul"), keys, "pos").row_number("_n").df
        out = out.select(*keys, (F.col("_n") - 1).alias("pos"), "cumul")
        for name, prefix in {"id": "Numéros", "invert": "Cotes fil", "depth": "Profondeurs",
                             "ground": "Cotes Terrain", "partial": "Distances partielles"}.items():
            value = F.col("value") if name == "id" else number(F.col("value"))
            side = self._section(prefix).select(*keys, "pos", value.alias(name))
            out = out.join(side, [*keys, "pos"], "left")
        return materialize(out.na.fill("", ["id"]).na.fill(0.0, ["invert", "depth", "ground"]))

    @cached_property
    def profile_pipes(self) -> DataFrame:
        """Pipe of each profile by nearest total length."""
        keys = ["file", "profile_idx"]
        totals = self.stations.groupBy(*keys).agg(
            F.max_by("cumul", "pos").alias("total"), F.count(F.lit(1)).alias("_n")
        ).where(F.col("_n") >= 2)
        pipes = self.plan_pipes.select("file", F.col("ent_no").alias("pipe_no"), "length")
        if self.unique_pipe:
            pairs = matching.serial_match_values(
                totals, pipes, probe_key="profile_idx", value_key="pipe_no",
                probe_order="profile_idx", value_order="pipe_no", probe_value="total",
                value="length", by=["file"])
        else:
            pairs = spatial.nearest_value(
                totals, pipes, probe_key="profile_idx", value_key="pipe_no", probe_value="total",
                value="length", order="pipe_no", by=["file"])
        return materialize(totals.drop("_n").join(pairs, keys))

    @cached_property
    def _station_spots(self) -> DataFrame:
        """Stations of matched profiles with their place on the pipe."""
        keys = ["file", "profile_idx"]
        used = self.profile_pipes.select(*keys, F.col("pipe_no").alias("ent_no"))
        asked = self.stations.join(used, keys)
        # a shared pipe serves several profiles, so the profile is part of the line key
        line = self.vertices.join(used, _KEY)
        spots = polylines.points_at(
            line.select(*keys, "v_no", "x", "y"), asked.select(*keys, "pos", "cumul"), keys,
            target="cumul")
        return materialize(asked.join(spots.drop("cumul"), [*keys, "pos"]))

    @cached_property
    def profile_nodes(self) -> DataFrame:
        """Stations snapped to the nearest free node block of their profile."""
        keys = ["file", "profile_idx"]
        spots = self._station_spots
        blocks = self.of("INSERT", F.col("layer") == NODES).select(
            "file", F.col("ent_no").alias("node_no"), "x", "y")
        # a profile competes only for the blocks in reach of its own stations
        near = spatial.with_neighbour_cells(spots, "x", "y", NODE_RADIUS).select(
            *keys, "_cx", "_cy").distinct()
        pool = spatial.with_own_cell(blocks, "x", "y", NODE_RADIUS).join(
            near, ["file", "_cx", "_cy"]).select(*keys, "node_no", "x", "y")
        if self.unique_pipe:
            pairs = matching.serial_match(
                spots, pool, probe_key="pos", point_key="node_no", probe_order="pos",
                point_order="node_no", radius=NODE_RADIUS, by=keys)
        else:
            pairs = spatial.nearest(
                spots, pool, probe_key="pos", point_key="node_no", order="node_no",
                radius=NODE_RADIUS, by=keys)
        at = blocks.withColumnsRenamed({"x": "_bx", "y": "_by"})
        snapped = spots.join(pairs, [*keys, "pos"], "left").join(at, ["file", "node_no"], "left")
        if self.unique_pipe:
            snapped = snapped.withColumns({"x": F.coalesce("_bx", "x"), "y": F.coalesce("_by", "y")})
        return materialize(snapped.select(
            *keys, "pos", "id", "invert", "depth", "ground", "cumul", "x", "y", "node_no"))

    @property
    def profile_segments(self) -> DataFrame:
        """Pieces between consecutive stations with length, slope and interpolated ends."""
        keys = ["file", "profile_idx"]
        seq = Sequence(self._station_spots, keys, "pos").following(
            to_node=F.col("id"), _c=F.col("cumul"), _i=F.col("invert"), x2=F.col("x"),
            y2=F.col("y"))
        length = or_default(F.col("partial"), F.col("_c") - F.col("cumul"))
        slope = F.when(
            (F.col("invert") != 0) & (F.col("_i") != 0),
            F.try_divide(F.col("_i") - F.col("invert"), length)).otherwise(F.lit(0.0))
        about = self.profiles.select(*keys, F.coalesce("diam", F.lit(0)).alias("diam"),
                                     F.coalesce("material", F.lit("")).alias("material"))
        return seq.df.where(F.col("_c").isNotNull()).withColumns(
            {"length_m": length, "slope": slope}
        ).join(about, keys).select(
            *keys, "pos", F.col("id").alias("from_node"), "to_node", "length_m",
            (F.col("slope") * 100).alias("slope_pct"), "slope", "diam", "material",
            F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")

    @cached_property
    def annotated_pipes(self) -> DataFrame:
        """Plan pipes with profile data, or with the nearest label where there is none."""
        keys = ["file", "profile_idx"]
        by_profile = self.profile_pipes.join(self.profiles.select(*keys, "diam", "material"), keys)
        # several profiles on one pipe: the last one stays
        best = by_profile.groupBy("file", F.col("pipe_no").alias("ent_no")).agg(
            F.max_by(F.struct("profile_idx", "diam", "material", "total"), "profile_idx")
            .alias("_p"))
        pipes = self.plan_pipes.join(best, _KEY, "left")
        free = pipes.where(F.col("_p").isNull()).select(*_KEY)
        corners = self.vertices.join(free, _KEY, "left_semi").withColumn(
            "corner", F.struct("ent_no", "v_no"))
        named = self.pipe_labels.withColumnRenamed("ent_no", "label_no")
        near = spatial.nearest(corners, named, probe_key="corner", point_key="label_no",
                               order="label_no", radius=FILL_RADIUS, by=["file"])
        chosen = near.groupBy("file", F.col("corner.ent_no").alias("ent_no")).agg(
            F.min(F.struct("distance", "label_no")).alias("_m")
        ).select(*_KEY, F.col("_m.label_no").alias("label_no"))
        text = named.select("file", "label_no", F.struct("diam", "material", "length", "slope")
                            .alias("_t"))
        out = pipes.join(chosen, _KEY, "left").join(text, ["file", "label_no"], "left")
        return materialize(out.select(
            *_KEY, "layer", "vertices", "mean_x", "mean_y", "length",
            F.coalesce("_p.profile_idx", F.lit(-1)).alias("profile_idx"),
            F.coalesce("_p.diam", int_prefix(F.col("_t.diam")).cast("int"), F.lit(0))
            .alias("diam"),
            F.coalesce("_p.material", "_t.material", F.lit("")).alias("material"),
            F.col("_p.total").alias("total_length"),
            F.coalesce(float_prefix(F.col("_t.length")), F.lit(0.0)).alias("label_length"),
            F.coalesce(float_prefix(F.col("_t.slope")), F.lit(0.0)).alias("label_slope")))

    @cached_property
    def enriched_manholes(self) -> DataFrame:
        """Manholes with the profile node at their place: equal to one decimal, else within 0.5."""
        def spot(df: DataFrame) -> DataFrame:
            return df.withColumn("_k", F.concat_ws("_", to_fixed(F.col("x"), 1),
                                                   to_fixed(F.col("y"), 1)))

        place = F.struct("profile_idx", "pos")
        data = F.struct("id", "invert", "depth", "ground", "cumul", "x", "y")
        nodes = spot(self.profile_nodes)
        # largest cumulative distance per place, the earliest of equals; a place is as old as
        # its first node
        held = nodes.groupBy("file", "_k").agg(
            F.max("cumul").alias("_max"), F.min(place).alias("_order"))
        held = nodes.join(held, ["file", "_k"]).where(F.col("cumul") == F.col("_max")).groupBy(
            "file", "_k", "_order").agg(F.min_by(data, place).alias("_n"))
        held = Sequence(held, ["file"], "_order").row_number("node_ord").df.select(
            "file", "_k", "node_ord", "_n")
        held = materialize(held)
        people = spot(self.manholes).join(held.select("file", "_k", "_n"), ["file", "_k"], "left")
        people = materialize(people.withColumn("mh", F.struct("part", "turn")))
        rest = people.where(F.col("_n").isNull()).select("file", "mh", "x", "y")
        close = spatial.first_around(
            rest, held.select("file", "node_ord", F.col("node_ord").alias("o"), "_n.x", "_n.y"),
            probe_key="mh", point_key="node_ord", order="o", half=SNAP_RADIUS, square=False,
            by=["file"])
        found = close.join(held.select("file", "node_ord", F.col("_n").alias("_f")),
                           ["file", "node_ord"]).select("file", "mh", "_f")
        n = F.coalesce("_n", "_f")
        return materialize(people.join(found, ["file", "mh"], "left").select(
            "file", "part", "turn", "id", "ct", "cr", "pp", "x", "y", "matched", "distance",
            n["id"].alias("profile_id"), n["invert"].alias("profile_invert"),
            n["depth"].alias("profile_depth"), n["ground"].alias("profile_ground"),
            n["cumul"].alias("profile_cumul")))

    # ---- report -------------------------------------------------------------------------

    def anchors(self) -> tuple[DataFrame, DataFrame]:
        """Vertices lying on a node block (2 units), and the block nearest to each pipe end."""
        blocks = self.of("INSERT", F.col("layer") == NODES).select(
            "file", F.col("ent_no").alias("node_no"), F.col("ent_no").alias("o"), "x", "y")
        corners = self.vertices.join(self.classified.select(*_KEY), _KEY, "left_semi").withColumn(
            "corner", F.struct("ent_no", "v_no"))
        on_node = spatial.nearest(corners, blocks, probe_key="corner", point_key="node_no",
                                  order="o", radius=ANCHOR_RADIUS, by=["file"])
        last = corners.groupBy(*_KEY).agg(F.max("v_no").alias("_last"))
        ends = corners.join(last, _KEY).where((F.col("v_no") == 1) | (F.col("v_no") == F.col("_last")))
        at_end = spatial.nearest(ends, blocks, probe_key="corner", point_key="node_no", order="o",
                                 radius=END_RADIUS, by=["file"])
        return on_node, at_end

    def report(self) -> DataFrame:
        """One row per file with the counts and sums of everything extracted.

        Every extracted item is one narrow row (file, what, length); all counts and sums are one
        aggregation of these, combined before the shuffle.  A file without any item has zeros.
        """
        parts = {
            "manholes": (self.manholes, None),
            "with_label": (self.manholes, F.col("part") == 0),
            "with_insert": (self.of("INSERT", F.col("layer") == NODES), None),
            "manholes_matched": (self.manholes, F.col("matched")),
            "labels_unmatched": (self.manholes, (F.col("part") == 0) & ~F.col("matched")),
            "inserts_unlabelled": (self.manholes, F.col("part") == 1),
            "profiles": (self.profiles, None),
            "profile_segments": (self.profile_segments, None),
            "polylines": (self.classified, None),
            "pipes": (self.classified, F.col("class") == "pipe"),
            "profile_zone": (self.classified, F.col("class") == "profile_zone"),
            "construction": (self.classified, F.col("class") != "pipe"),
            "pipe_texts": (self.of("TEXT", F.col("layer") == MAIN_TEXT), None),
            "label_groups": (self.label_groups, None),
            "dn_pipes": (self.dn_pipes, None),
            "dn200": (self.dn_pipes, F.col("diam") == "200"),
            "second_nodes": (self.second_nodes, None),
            "second_lines": (self.second_lines, None),
            "projected": (self.projected, None),
            "extra_nodes": (self.extra_nodes, None),
        }
        dn = self.measured(self.dn_pipes)
        measured = {"pipe_length": self.plan_pipes, "dn_length": dn,
                    "dn200_length": dn.where(F.col("diam") == "200")}
        nothing = F.lit(None).cast("double").alias("length")
        rows = [(df if test is None else df.where(test)).select("file", F.lit(n).alias("what"), nothing)
                for n, (df, test) in parts.items()]
        rows += [df.select("file", F.lit(n).alias("what"), "length") for n, df in measured.items()]
        rows.append(self.entities.select("file", F.lit("").alias("what"), nothing).distinct())
        # lengths count to two decimals; sums of whole hundredths do not depend on the order
        units = F.round(round_half_up(F.col("length"), 2) * 100).cast("bigint")
        return reduce(DataFrame.unionByName, rows).groupBy("file").agg(
            *[F.count_if(F.col("what") == n).alias(n) for n in parts],
            *[(F.coalesce(F.sum(F.when(F.col("what") == n, units)), F.lit(0)) / 100).alias(n)
              for n in measured])

    def measured(self, pipes: DataFrame) -> DataFrame:
        """``pipes`` with their length; a pipe without vertices has none."""
        keys = pipes.select(*_KEY)
        found = polylines.lengths(self.vertices.join(keys, _KEY, "left_semi"), _KEY)
        return pipes.join(found.select(*_KEY, "length"), _KEY, "left")

    def rounded_segments(self) -> DataFrame:
        """Profile segments as an extraction writes them: lengths and slopes to two decimals."""
        return self.profile_segments.withColumns({
            c: round_half_up(F.col(c), 2) for c in ("length_m", "slope_pct")})

    def write_report(self, folder: str) -> None:
        """The report as one JSON document per file and line, and next to it the items it counts
        as tables keyed by file, since a document cannot hold any number of them."""
        r = self.report()
        r.select(
            F.struct("file").alias("meta"),
            F.struct(F.col("manholes").alias("count"), F.col("with_label").alias("withLabel"),
                     F.col("with_insert").alias("withInsert"),
                     F.col("manholes_matched").alias("labeledAndMatched"),
                     F.col("labels_unmatched").alias("labeledUnmatched"),
                     F.col("inserts_unlabelled").alias("unlabeledInserts")).alias("manholes"),
            F.struct(F.col("profiles").alias("count")).alias("profiles"),
            F.struct(F.col("profile_segments").alias("count")).alias("profileSegments"),
            F.struct(F.col("polylines").alias("totalLwpolylines"), F.col("pipes").alias("realPipes"),
                     F.col("profile_zone").alias("profileZone"),
                     F.col("construction").alias("profileConstructionLines"),
                     F.col("pipe_length").alias("totalLength")).alias("pipesEU1"),
            F.struct(F.col("pipe_texts").alias("totalTexts"), F.col("label_groups").alias("groups"))
            .alias("pipeLabels"),
            F.struct(F.col("dn200").alias("count"), F.col("dn200_length").alias("totalLength"))
            .alias("dn200"),
            F.struct(F.col("second_nodes").alias("inserts"), F.col("second_lines").alias("lines"))
            .alias("assai"),
            F.struct(F.col("projected").alias("count")).alias("reseauProjete"),
            F.struct(F.col("extra_nodes").alias("count")).alias("newEu1Inserts"),
        ).write.json(f"{folder}/report")
        for name, df in (("manholes", self.manholes), ("profiles", self.profiles),
                         ("profile_segments", self.rounded_segments()),
                         ("pipes", self.classified), ("pipe_labels", self.label_groups)):
            df.write.parquet(f"{folder}/{name}")


def sewer_layers(entities: DataFrame) -> DataFrame:
    """Distinct layers per file, in order."""
    return entities.where(F.coalesce("layer", F.lit("")) != "").select("file", "layer").distinct(
    ).orderBy("file", "layer")


def keyword_network(drawing: Drawing) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pipes, lines and manholes by words in the layer name."""
    sewer = F.coalesce(F.col("layer"), F.lit("")).rlike(labels.SEWER_WORDS)
    pipes = drawing.shapes(sewer)
    measured = polylines.lengths(
        drawing.vertices.join(pipes.select(*_KEY), _KEY, "left_semi"), _KEY).select(*_KEY, "length")
    lines = drawing.of("LINE", sewer).dropna(subset=["x", "x2"]).select(
        *_KEY, "layer", "x", "y", "x2", "y2")
    manholes = drawing.of("INSERT", sewer).select(
        *_KEY, "layer", "x", "y", "block_name", "rotation")
    return pipes.join(measured, _KEY), lines, manholes
