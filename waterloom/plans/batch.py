"""A batch of files of any kind as one job per kind.

Files are told apart by their ending, drawings by what they hold and CSV files by their rows; each
kind then runs its branch over all its files together.  Everything stays keyed by ``file``:
numbers, identifiers and coordinates of one file never meet those of another.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waterloom import schema
from waterloom.operators import detect
from waterloom.operators.ordered import Sequence
from waterloom.plans import features, mapping, model_text
from waterloom.plans.drawing import Drawing
from waterloom.plans.views import acceptance
from waterloom.session import materialize
from waterloom.sources import csvfiles, dispatch, dxf, inp
from waterloom.sources.lines import read_lines

SHORT = "File too short or empty"
UNKNOWN = "Not a DXF, JSON, CSV or INP file"
#: Sections that one table file may hold.
TABLES = [s for s in schema.DETECTABLE if s in mapping.ID_PREFIX]


class Tables:
    """Element tables out of the rows of many CSV files (file, row_no, cells, headers).

    Sectioned files give the tables of their sections.  Every other file is one table: it is
    mapped unasked when its kind is sure enough (``waiting`` has the others), by its headers or, when no
    header says anything, by the place of its columns.  ``chosen`` (file, section) names kinds by
    hand, ``overrides`` (file, header, field, ignored) columns.
    """

    def __init__(self, rows: DataFrame, chosen: DataFrame | None = None,
                 overrides: DataFrame | None = None):
        self.rows, self.chosen, self.overrides = materialize(rows), chosen, overrides

    @cached_property
    def errors(self) -> DataFrame:
        return csvfiles.short_files(self.rows)

    @cached_property
    def sectioned(self) -> DataFrame:
        found = csvfiles.is_sectioned(self.rows).where("sectioned").select("file")
        return materialize(found.join(self.errors, "file", "left_anti"))

    @cached_property
    def plain(self) -> DataFrame:
        """Rows of the files that are one table each."""
        return self.rows.join(self.sectioned, "file", "left_anti").join(
            self.errors.select("file"), "file", "left_anti")

    @cached_property
    def detected(self) -> DataFrame:
        """file, detected_type, confidence, ambiguous, acceptance; a file nothing fits has nulls."""
        found = detect.column_matches(csvfiles.cells_of(self.plain), ["file"])
        best = detect.detect_tables(detect.table_scores(found, ["file"]), ["file"])
        files = self.plain.select("file").distinct()
        return materialize(files.join(best, "file", "left").withColumn(
            "acceptance", acceptance(F.coalesce("confidence", F.lit(0.0)))))

    @cached_property
    def kinds(self) -> DataFrame:
        """file and section of every table file that is mapped."""
        sure = self.detected.where("acceptance <> 'ask'").select(
            "file", F.col("detected_type").alias("section"))
        if self.chosen is not None:
            named = self.chosen.select("file", F.upper("section").alias("section"))
            sure = sure.join(named, "file", "left_anti").unionByName(
                named.join(self.plain.select("file").distinct(), "file", "left_semi"))
        return materialize(sure.where(F.col("section").isin(TABLES)))

    @cached_property
    def waiting(self) -> DataFrame:
        """Table files whose kind has to be chosen, with the best guess."""
        return self.detected.join(self.kinds, "file", "left_anti")

    def _mapped(self, section: str) -> dict[str, DataFrame]:
        mine = self.kinds.where(F.col("section") == section).select("file")
        rows = materialize(self.plain.join(mine, "file", "left_semi"))
        suggested = detect.suggest_for_type(csvfiles.cells_of(rows), section, ["file"])
        overrides = self.overrides
        if overrides is None:
            overrides = suggested.sparkSession.createDataFrame(
                [], "file string, header string, field string, ignored boolean")
        fields = materialize(detect.apply_overrides(suggested, overrides, ["file"]).where(
            F.col("field").isNotNull()).select("file", "header", "field"))
        unnamed = rows.join(fields, "file", "left_anti")
        return mapping.map_table(
            rows, fields.unionByName(mapping.positional_mapping(unnamed, section)), section)

    @cached_property
    def elements(self) -> dict[str, DataFrame]:
        """Element tables by kind, each with ``file`` and ``row_no``, values as text."""
        frames: dict[str, list[DataFrame]] = {}
        present = [r[0] for r in self.kinds.select("section").distinct().collect()]
        for section in sorted(present):
            for kind, df in self._mapped(section).items():
                frames.setdefault(kind, []).append(df)
        routed = csvfiles.section_rows(self.rows.join(self.sectioned, "file", "left_semi"))
        parts = csvfiles.section_tables(routed)
        pairs = parts.pop("key_values")
        parts.pop("labels")
        for kind in ("options", "times"):
            parts[kind] = pairs.where(F.col("section") == kind.upper()).drop("section")
        for kind, df in parts.items():
            frames.setdefault(kind, []).append(df)

        def plain(df: DataFrame) -> DataFrame:
            keep = ("file", "row_no", "factors")
            return df.select(*[F.col(c) if c in keep else F.col(c).cast("string").alias(c)
                               for c in df.columns])
        return {kind: materialize(reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True), map(plain, dfs)))
            for kind, dfs in frames.items() if kind in map(str.lower, model_text.SECTIONS)}

    @cached_property
    def files(self) -> DataFrame:
        """Files that a model is made of."""
        return self.sectioned.unionByName(self.kinds.select("file")).distinct()

    def models(self, title: str = "Generated from CSV") -> DataFrame:
        """One model text per file: file, part, row, line."""
        return model_text.table_models(self.files, self.elements, title)

    def project(self, title: str = "Batch Generated from CSV Files") -> DataFrame:
        """One model of all files, in the order of their names: part, row, line."""
        def renumbered(df: DataFrame) -> DataFrame:
            order = Sequence(df.withColumnRenamed("row_no", "_row"), [], ["file", "_row"])
            return order.row_number("row_no").df.drop("_row")
        spark = self.rows.sparkSession
        return model_text.table_model(
            spark, {k: renumbered(df).drop("file") for k, df in self.elements.items()}, title)


class Batch:
    """Every file under ``path``, each sent through the branch of its kind."""

    def __init__(self, spark: SparkSession, path, *, unique_pipe: bool = True,
                 chosen: DataFrame | None = None, overrides: DataFrame | None = None):
        self.spark, self.path, self.unique_pipe = spark, path, unique_pipe
        self.chosen, self.overrides = chosen, overrides

    @cached_property
    def files(self) -> DataFrame:
        """file and branch: drawing, proxy, model, table, sectioned, extracted; null with an error."""
        listed = materialize(dispatch.list_files(self.spark, self.path))
        branch = F.when(F.col("kind") == "dxf", F.coalesce(
            F.when(F.col("format") == "proxy", "proxy"), F.lit("drawing"))).when(
            F.col("kind") == "csv", F.when(F.col("sectioned"), "sectioned").otherwise("table")).when(
            F.col("kind") == "inp", "model").when(F.col("kind") == "json", "extracted")
        out = listed.join(self._formats, "file", "left").join(
            self.tables.sectioned.withColumn("sectioned", F.lit(True)), "file", "left").join(
            self.errors.select("file", "error"), "file", "left")
        return out.select("file", "kind", F.when(F.col("error").isNull(), branch).alias("branch"))

    @cached_property
    def errors(self) -> DataFrame:
        """Files that no branch can use: file, error."""
        listed = dispatch.list_files(self.spark, self.path)
        lines = self.tables.rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
        csv = listed.where("kind = 'csv'").join(lines, "file", "left").where(
            F.coalesce("lines", F.lit(0)) < 2).select("file", F.lit(SHORT).alias("error"))
        return materialize(csv.unionByName(listed.where("kind IS NULL").select(
            "file", F.lit(UNKNOWN).alias("error"))))

    @cached_property
    def tables(self) -> Tables:
        lines = read_lines(self.spark, self.path, **dispatch.of_kind("csv"))
        return Tables(csvfiles.rows_of(lines), self.chosen, self.overrides)

    @cached_property
    def _tags(self) -> DataFrame:
        return materialize(dxf.read_tags(self.spark, self.path, **dispatch.of_kind("dxf")))

    @cached_property
    def _formats(self) -> DataFrame:
        return materialize(dxf.drawing_format(self._tags))

    @cached_property
    def _marked(self) -> DataFrame:
        return materialize(dxf.mark_entities(self._tags).join(self._formats, "file"))

    @cached_property
    def drawing(self) -> Drawing:
        """The networks of all plain drawings."""
        return Drawing.from_tags(
            self._marked.where("format = 'plain'").drop("format"), self.unique_pipe)

    @cached_property
    def proxies(self) -> dict[str, DataFrame]:
        """The networks of all drawings with proxy entities."""
        marked = self._marked.where("format = 'proxy'").drop("format")
        return features.proxy_network(dxf.proxy_entities(marked), dxf.insert_blocks(marked))

    @cached_property
    def model_tables(self) -> dict[str, DataFrame]:
        """Tables of all hydraulic models."""
        return inp.model_tables(
            inp.sections(read_lines(self.spark, self.path, **dispatch.of_kind("inp"))))

    def extracted(self, schema_) -> DataFrame:
        """Documents of all extracted JSON files."""
        return dispatch.read_extracted(self.spark, self.path, schema_, **dispatch.of_kind("json"))

    @cached_property
    def supply_network(self) -> dict[str, DataFrame]:
        """Junctions, pipes and valves of every drawing's supply, second and fire lines."""
        d = self.drawing
        families = {"supply": d.supply_pipes, "dn": d.dn_pipes, "fire": d.fire_pipes}
        pipes = reduce(DataFrame.unionByName, [
            df.select("file", F.lit(name).alias("family"), "ent_no",
                      (F.col("diam") if "diam" in df.columns else F.lit(None)).cast("string")
                      .alias("diam")) for name, df in families.items()])
        pipes = materialize(pipes)
        nodes = reduce(DataFrame.unionByName, [
            df.select("file", F.lit(name).alias("family"), "ent_no", "x", "y", "block_name")
            for name, df in (("supply", d.supply_nodes), ("fire", d.fire_nodes))])
        corners = d.vertices.join(pipes.select("file", "family", "ent_no"), ["file", "ent_no"])
        return model_text.geometry_network(pipes, corners, nodes, ["file"])

    def supply_models(self) -> DataFrame:
        """One supply model per drawing: file, part, row, line."""
        net = self.supply_network
        return model_text.geometry_models(net["pipes"].select("file"), net)

    def sewer_models(self) -> DataFrame:
        """One sewer model per drawing: file, part, row, line."""
        m = self.drawing.enriched_manholes.withColumn("row_no", F.col("part") * 1000 + F.col("turn"))
        m = Sequence(m.drop("row_no"), ["file"], ["part", "turn"]).row_number("row_no").df
        s = Sequence(self.drawing.profile_segments, ["file"], ["profile_idx", "pos"]).row_number("row_no").df
        return model_text.sewer_models(
            self.drawing.entities.select("file"), model_text.sewer_tables(m, s, ["file"]))

    def write(self, folder: str) -> None:
        """Models, features and the errors of the whole batch, a folder for each kind of output."""
        model_text.write_models(self.tables.models(), f"{folder}/models")
        model_text.write_models(self.supply_models(), f"{folder}/supply")
        model_text.write_models(self.sewer_models(), f"{folder}/sewer")
        found = features.drawing_features(self.drawing).unionByName(
            features.proxy_features(self.proxies))
        features.write_features(found, f"{folder}/features")
        self.errors.write.json(f"{folder}/errors")
