"""Loosely structured CSV files: delimiter, cells, sectioned files, typed geometry files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterloom import schema
from waterloom.functions.numbers import float_prefix, number, or_default, text_or, trim
from waterloom.functions.text import drop_comment_cell, number_text, parse_label
from waterloom.operators.ordered import Sequence
from waterloom.operators.profiling import junk_columns
from waterloom.session import materialize
from waterloom.sources.lines import read_lines

# Delimiters in order of preference and headers of a section column.
DELIMITERS = [",", "\t", ";", "|"]
SECTION_COLUMN_NAMES = [
    "section", "type", "categorie", "category", "element", "elementtype", "القسم", "النوع",
]


def delimiter_of(header: Column) -> Column:
    """The delimiter that occurs most in a header line; the first of equals; comma if none."""
    best = F.array_max(F.array(*[
        F.struct((F.length(header) - F.length(F.replace(header, F.lit(d), F.lit("")))).alias("n"),
                 F.lit(-i).alias("o"), F.lit(d).alias("d"))
        for i, d in enumerate(DELIMITERS)
    ]))
    return best["d"]


def rows_of(lines: DataFrame, utf8: bool = True) -> DataFrame:
    """Non-blank lines split by their file's delimiter: file, row_no (header is 0), cells.

    Blank lines have no number; lines read split by split are numbered split by split.
    """
    text = F.col("text")
    if utf8:
        text = F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    kept = lines.withColumn("text", F.regexp_replace(text, r"^\x{FEFF}", "")).where(
        trim(F.col("text")) != ""
    )
    # written: one row per file whose size is known, so that a big file's lines can be split
    heads = materialize(kept.groupBy("file").agg(
        F.min_by("text", "line_no").alias("_header")
    ).withColumn("delimiter", delimiter_of(F.col("_header"))))
    kept = Sequence(kept, "file", "line_no", slice_by="block" if "block" in kept.columns else None
                    ).row_number("_n").df
    split = F.transform(
        F.split(F.col("text"), F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E"))), trim
    )
    return kept.join(heads, "file").select(
        "file", (F.col("_n") - 1).alias("row_no"), split.alias("cells"),
        "delimiter", F.transform(
            F.split(F.col("_header"), F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E"))),
            trim).alias("headers"),
    )


def read_rows(spark: SparkSession, path) -> DataFrame:
    return rows_of(read_lines(spark, path))


def short_files(rows: DataFrame) -> DataFrame:
    """Files with a header but no data row."""
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    return counts.where(F.col("lines") < 2).select(
        "file", F.lit("File too short or empty").alias("error"))


def cells_of(rows: DataFrame) -> DataFrame:
    """Long cells: missing cells are empty, surplus cells are dropped."""
    pairs = F.transform(F.col("headers"), lambda h, i: F.struct(
        i.alias("col_no"), h.alias("header"),
        F.coalesce(F.try_element_at(F.col("cells"), i + 1), F.lit("")).alias("value")))
    return rows.where(F.col("row_no") > 0).select("file", "row_no", F.inline(pairs))


def is_sectioned(rows: DataFrame) -> DataFrame:
    """Per file: a section column comes first and at least two known sections are in any row."""
    first = F.upper(F.element_at("cells", 1))
    header = F.lower(F.element_at("headers", 1)).isin(SECTION_COLUMN_NAMES)
    known = F.when((F.col("row_no") > 0) & first.isin(schema.KNOWN_SECTIONS), first)
    return rows.groupBy("file").agg(
        (F.bool_and(header) & (F.count_distinct(known) >= 2)).alias("sectioned"))


def section_rows(rows: DataFrame) -> DataFrame:
    """Rows of sectioned files: file, row_no, section, values (comment cells emptied)."""
    section = F.upper(F.element_at("cells", 1))
    values = F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("headers"))),
        lambda i: drop_comment_cell(F.coalesce(F.try_element_at(F.col("cells"), i), F.lit(""))),
    )
    return rows.where((F.col("row_no") > 0) & (section != "")).select(
        "file", "row_no", section.alias("section"), values.alias("values")
    )


def _cell(i: int) -> Column:
    raw = F.coalesce(F.try_element_at(F.col("values"), F.lit(i + 1)), F.lit(""))
    return F.when(raw == "", raw).otherwise(F.coalesce(number_text(number(raw)), raw))


def section_tables(routed: DataFrame) -> dict[str, DataFrame]:
    """Element tables, options, times, controls and labels of sectioned files."""
    out: dict[str, DataFrame] = {}
    for section, fields in schema.POSITIONAL.items():
        picked = routed.where(F.col("section") == section)
        columns = []
        for i, field in enumerate(fields):
            if field == "factors":
                rest = F.filter(F.slice("values", 2, 2**31 - 2), lambda v: (v != "") & (v != ";"))
                columns.append(F.filter(F.transform(rest, number), lambda n: n.isNotNull())
                               .alias(field))
            else:
                columns.append(_cell(i).alias(field))
        out[section.lower()] = picked.select("file", "row_no", *columns)
    pairs = routed.where(F.col("section").isin("OPTIONS", "TIMES", "ENERGY", "REACTIONS")).select(
        "file", "row_no",
        F.when(F.col("section") == "TIMES", "TIMES").otherwise("OPTIONS").alias("section"),
        F.element_at("values", 1).alias("key"),
        trim(F.array_join(F.slice("values", 2, 2**31 - 2), "\t")).alias("value"),
    ).where((F.col("key") != "") & (F.col("value") != ""))
    out["key_values"] = pairs.groupBy("file", "section", "key").agg(
        F.max_by("value", "row_no").alias("value"), F.min("row_no").alias("row_no"))
    text = trim(F.array_join(F.filter("values", lambda v: (v != "") & (v != ";")), ","))
    out["controls"] = routed.where(F.col("section") == "CONTROLS").select(
        "file", "row_no", text.alias("text")).where(F.col("text") != "")
    parsed = parse_label(trim(F.array_join("values", " ")))
    out["labels"] = routed.where(F.col("section") == "LABELS").select(
        "file", "row_no", parsed.alias("_l")).where(F.col("_l").isNotNull()).select(
        "file", "row_no", "_l.*")
    return out


def section_summary(routed: DataFrame) -> DataFrame:
    """Rows per known section, and distinct identifiers for patterns and curves."""
    known = routed.where(F.col("section").isin(schema.KNOWN_SECTIONS))
    grouped = F.col("section").isin("PATTERNS", "CURVES")
    return known.groupBy("file", "section").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.when(grouped, F.element_at("values", 1))).alias("groups"),
    )


def section_junk(rows: DataFrame) -> DataFrame:
    """Junk columns of sectioned files, the section column aside."""
    return junk_columns(cells_of(rows).where(F.col("col_no") > 0), ["file", "header"])


def typed_features(cells: DataFrame) -> dict[str, DataFrame]:
    """Geometry rows by their ``type`` column: two-point pipes and point nodes.

    Rows whose coordinates do not start with a number are dropped.
    """
    names = ["type", "x1", "y1", "x2", "y2", "x", "y", "diam", "layer", "length", "slope", "block",
             "name", "rotation"]
    wide = cells.withColumn("header", F.lower("header")).where(F.col("header").isin(names)).groupBy(
        "file", "row_no").agg(*[
            F.max_by(F.when(F.col("header") == n, F.col("value")),
                     F.when(F.col("header") == n, F.col("col_no"))).alias(n) for n in names])
    wide = wide.withColumn("type", F.lower(F.coalesce("type", F.lit(""))))
    ends = {c: float_prefix(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")}
    diam = F.coalesce("diam", F.lit(""))
    pipes = wide.where(F.col("type").isin("aep", "dn", "incendie")).select(
        "file", "row_no", F.col("type").alias("family"), *ends.values(), diam.alias("diam"),
        text_or(F.col("layer"), F.when(F.col("type") == "incendie", "_RESEAU INCENDIE")
                .when(diam != "", F.concat(F.lit("DN"), diam)).otherwise("")).alias("layer"),
        float_prefix(F.col("length")).alias("label_length"),
        F.nullif(F.col("slope"), F.lit("")).alias("slope"),
    ).dropna(subset=["x1", "y1", "x2", "y2"])
    family = F.when(F.col("type").isin("aepnode", "aep_node"), "aep").when(
        F.col("type").isin("incendienode", "incendie_node", "pinet"), "incendie")
    label = text_or(F.col("block"), text_or(F.col("name"), F.when(
        F.col("family") == "incendie", "PI").otherwise("")))
    nodes = wide.withColumn("family", family).where(F.col("family").isNotNull()).select(
        "file", "row_no", "family", float_prefix(F.col("x")).alias("x"),
        float_prefix(F.col("y")).alias("y"), label.alias("block_name"),
        or_default(float_prefix(F.col("rotation")), 0.0).alias("rotation"),
    ).dropna(subset=["x", "y"])
    return {"pipes": pipes, "nodes": nodes}
