"""Hydraulic model files: sections and positional tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterloom import schema
from waterloom.functions.numbers import number, or_default, text_or, trim
from waterloom.operators.ordered import Sequence
from waterloom.sources.lines import read_lines


def sections(lines: DataFrame) -> DataFrame:
    """Data lines with their section; a repeated section replaces the earlier one.

    Columns: file, section, line_no, cells, shifted (cells without the empty ones), comment.
    """
    t = trim(F.col("text"))
    seq = Sequence(
        lines.withColumn("text", t), "file", "line_no",
        slice_by="block" if "block" in lines.columns else None,
    )
    opens = F.col("text").startswith("[") & F.col("text").endswith("]")
    name = F.upper(F.expr("substring(text, 2, length(text) - 2)"))
    marked = seq.compute(
        last={"_at": F.when(opens, F.col("line_no")), "section": F.when(opens, name)}
    ).df
    latest = marked.where(opens).groupBy("file", "section").agg(F.max("line_no").alias("_at"))
    data = marked.where(
        ~opens & F.col("section").isNotNull() & (F.col("text") != "")
        & ~F.col("text").startswith(";")
    ).join(latest, ["file", "section", "_at"])
    head = trim(F.split_part("text", F.lit(";"), F.lit(1)))
    tail = F.when(F.col("text").contains(";"), trim(F.regexp_replace("text", "^[^;]*;", "")))
    cells = F.transform(F.split(F.col("_head"), "\t"), trim)
    return data.withColumn("_head", head).where(F.col("_head") != "").select(
        "file", "section", "line_no", cells.alias("cells"),
        F.filter(cells, lambda c: c != "").alias("shifted"),
        F.nullif(tail, F.lit("")).alias("comment"),
    )


def read_sections(spark: SparkSession, path) -> DataFrame:
    return sections(read_lines(spark, path))


def table(scan: DataFrame, section: str, shift_empty: bool = False) -> DataFrame:
    """One section as named text columns, cells by position.

    ``shift_empty`` drops empty cells first, so later cells move left.
    """
    cells = F.col("shifted" if shift_empty else "cells")
    fields = schema.POSITIONAL[section]
    return scan.where(F.col("section") == section).select(
        "file", F.col("line_no").alias("row_no"),
        *[F.nullif(F.try_element_at(cells, F.lit(i + 1)), F.lit("")).alias(f)
          for i, f in enumerate(fields)],
        "comment",
    )


def _num(name: str) -> Column:
    return or_default(number(F.col(name)), 0.0)


def model_tables(scan: DataFrame, shift_empty: bool = False) -> dict[str, DataFrame]:
    """Typed junctions (with coordinates), pipes, valves and coordinates of model files."""
    def get(section):
        return table(scan, section, shift_empty)

    spots = get("COORDINATES").select(
        "file", "row_no", "id", number(F.col("x")).alias("x"), number(F.col("y")).alias("y")
    )
    last = spots.groupBy("file", "id").agg(F.max_by(F.struct("x", "y"), "row_no").alias("_c"))
    junctions = get("JUNCTIONS").join(last, ["file", "id"], "left").select(
        "file", "row_no", "id", _num("elevation").alias("elevation"), _num("demand").alias("demand"),
        text_or(F.col("pattern"), "").alias("pattern"),
        F.coalesce("_c.x", F.lit(0.0)).alias("x"), F.coalesce("_c.y", F.lit(0.0)).alias("y"),
    )
    pipes = get("PIPES").select(
        "file", "row_no", "id", "node1", "node2",
        *[_num(c).alias(c) for c in ("length", "diameter", "roughness", "minorLoss")],
        text_or(F.col("status"), "Open").alias("status"),
    )
    valves = get("VALVES").select(
        "file", "row_no", "id", F.col("node1").alias("node"), _num("diameter").alias("diameter"),
        text_or(F.col("type"), "FCV").alias("type"), _num("setting").alias("setting"),
        _num("minorLoss").alias("minorLoss"),
    )
    return {"junctions": junctions, "pipes": pipes, "valves": valves, "coordinates": spots}
