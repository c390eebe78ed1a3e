"""Text files as numbered lines, read split by split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scanned_lines(spark: SparkSession, path, **options) -> DataFrame:
    """Lines as the scan gives them: file, block (offset of the split), _mid (order in the
    split), text (Latin-1, without line end), ending (``\\r\\n`` or ``\\n``) and the file's size."""
    raw = spark.read.options(**options).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("_mid"),
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("_raw"),
    )
    crlf = F.col("_raw").endswith("\r")
    return raw.select(
        "file", "block", "size", "_mid",
        F.when(crlf, F.expr("substring(_raw, 1, length(_raw) - 1)")).otherwise(F.col("_raw"))
        .alias("text"),
        F.when(crlf, F.lit("\r\n")).otherwise(F.lit("\n")).alias("ending"),
    )


def read_lines(spark: SparkSession, path, **options) -> DataFrame:
    """Lines of one or many single-byte (Latin-1) text files.

    Columns: file, block (offset of the split), line_no (0-based in the file), text (without
    line end), ending (``\\r\\n`` or ``\\n``).  A big file is read by many tasks; the line number
    is the position in the split plus the line count of the splits before it, so no line is
    moved or sorted to be numbered.  ``options`` choose files as Spark's readers do.
    """
    raw = scanned_lines(spark, path, **options)
    splits = raw.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("_lines"), F.min("_mid").alias("_first")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "file", "block", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_at")
    )
    return raw.join(starts, ["file", "block"]).select(
        "file", "block", (F.col("_at") + F.col("_mid") - F.col("_first")).alias("line_no"),
        "text", "ending",
    )


def lines_of(df: DataFrame, file: str, text: str) -> DataFrame:
    """Lines of a text column; a text is one row, so its lines stay in one task."""
    parts = df.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n")))
    return parts.select("file", F.col("pos").cast("bigint").alias("line_no"),
                        F.regexp_replace("col", "\r$", "").alias("text"))
