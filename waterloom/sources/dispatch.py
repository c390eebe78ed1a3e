"""Which reader a file needs, and the reader for extracted JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_kind(path: Column) -> Column:
    """json, csv, dxf or inp by extension; null for anything else."""
    ending = F.regexp_extract(F.lower(path), r"\.(json|csv|dxf|inp)$", 1)
    return F.nullif(ending, F.lit(""))


def of_kind(kind: str) -> dict[str, str]:
    """Reader options that choose the files of a kind, whatever the case of their ending."""
    ending = "".join(f"[{c}{c.upper()}]" for c in kind)
    return {"recursiveFileLookup": "true", "pathGlobFilter": f"*.{ending}"}


def list_files(spark: SparkSession, path) -> DataFrame:
    """Files under a folder or glob with their kind; contents are not read, empty files count."""
    # the listing names local files with three slashes, scans with one
    names = spark.read.option("recursiveFileLookup", True).text(path).inputFiles()
    listed = spark.createDataFrame(
        [(re.sub(r"^(\w+):///", r"\1:/", f),) for f in names], "file string")
    return listed.withColumn("kind", file_kind(F.col("file")))


def read_extracted(spark: SparkSession, path, schema, **options) -> DataFrame:
    """A pre-extracted JSON document per file, under a given schema."""
    return spark.read.options(**options).schema(schema).json(path, multiLine=True).withColumn(
        "file", F.col("_metadata.file_path")
    )


def items(documents: DataFrame, collection: str) -> DataFrame:
    """One row per item of a collection of extracted documents."""
    return documents.select("file", F.inline_outer(F.col(collection))).dropna(how="all")
