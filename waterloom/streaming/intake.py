"""Continuous intake: files that arrive in a folder are checked and merged batch by batch.

The stored table is kept as runs.  A batch writes what it adds as a run of its own, dealt into
``BUCKETS`` folders by a hash of the identifier; whenever ``FANOUT`` runs of one level are complete
they are written together as one run of the next.  After n batches there are at most FANOUT runs a
level, all read by one scan, and a row has been rewritten once a level.  A batch reads only the
buckets its identifiers and references fall into.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterloom.operators import validate
from waterloom.operators.merge import merge_elements
from waterloom.operators.profiling import to_cells
from waterloom.schema import RULES
from waterloom.session import materialize

#: Folders a run is dealt into; a table keeps the number it was begun with.
BUCKETS = 64
#: Runs of one level that are merged into one of the next.
FANOUT = 10
_BUCKET, _VERSION, _RUN = "_bucket", "_version", "_run"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _run_path(root: str, run: tuple[int, int]) -> str:
    return f"{root}/runs-{BUCKETS}/{_RUN}={run[0]:012d}-{run[1]:012d}"


def complete_runs(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """Finished runs by their first and last version, superseded ones included."""
    fs, path = _fs(spark, f"{root}/runs-{BUCKETS}")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    found = [re.fullmatch(rf"{_RUN}=(\d+)-(\d+)", n) for n in names]
    runs = [(int(m[1]), int(m[2])) for m in found if m]
    return sorted(r for r in runs if fs.exists(_fs(spark, _run_path(root, r) + "/_SUCCESS")[1]))


def live_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest runs that cover all versions, none twice."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs, key=lambda r: (r[0], -r[1])):
        if not out or first > out[-1][1]:
            out.append((first, last))
    return out


def due_merges(version: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """Runs to be made of others once ``version`` is complete, the shortest first."""
    out, span = [], fanout
    while (version + 1) % span == 0:
        out.append((version + 1 - span, version))
        span *= fanout
    return out


def bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(BUCKETS)).cast("int")


def _scan(spark: SparkSession, root: str, runs: list[tuple[int, int]]) -> DataFrame | None:
    """One scan of the runs that hold any row; columns that came later are null in earlier runs."""
    fs, _ = _fs(spark, root)
    paths = [p for p in (_run_path(root, r) for r in runs)
             if any("=" in s.getPath().getName() for s in fs.listStatus(_fs(spark, p)[1]))]
    if not paths:
        return None
    base = f"{root}/runs-{BUCKETS}"
    return spark.read.options(mergeSchema=True, basePath=base).parquet(*paths).drop(_RUN)


def load_elements(
    spark: SparkSession, root: str, before: int | None = None, buckets: list[int] | None = None,
) -> DataFrame | None:
    """All rows that complete versions (before ``before``) have added, or those in ``buckets``;
    ``row_no`` orders them over all versions.  None while there is no row."""
    runs = [r for r in complete_runs(spark, root) if before is None or r[0] < before]
    out = _scan(spark, root, live_runs(runs))
    if out is None:
        return None
    if before is not None:
        out = out.where(F.col(_VERSION) < before)
    if buckets is not None:
        out = out.where(F.col(_BUCKET).isin(buckets))
    return out.drop(_BUCKET, _VERSION)


def _write_run(rows: DataFrame, root: str, run: tuple[int, int]) -> None:
    rows.repartition(F.col(_BUCKET)).sortWithinPartitions(_BUCKET, _VERSION).write.mode(
        "overwrite").partitionBy(_BUCKET).parquet(_run_path(root, run))


def compact(spark: SparkSession, root: str, version: int, fanout: int = FANOUT) -> None:
    """Make the runs that are due after ``version``, and delete those superseded before it.

    A run is written from complete runs only and counts once it is complete itself; until then,
    and if this fails, the runs it is made of are read.  Runs that it supersedes stay for one more
    version, for readers that have begun.
    """
    runs = complete_runs(spark, root)
    live = set(live_runs(runs))
    for r in runs:
        if r not in live and r[1] < version:
            fs, path = _fs(spark, _run_path(root, r))
            fs.delete(path, True)
    for run in due_merges(version, fanout):
        inside = [r for r in live_runs(complete_runs(spark, root)) if run[0] <= r[0] and r[1] <= run[1]]
        rows = _scan(spark, root, inside) if len(inside) > 1 else None
        if rows is not None:
            _write_run(rows, root, run)


def _buckets_of(ids: DataFrame) -> list[int]:
    """Buckets (``BUCKETS`` at most) of the identifiers in column ``id``."""
    return [r[0] for r in ids.select(bucket(F.col("id")).alias("b")).distinct().collect()]


def merge_batch(batch: DataFrame, version: int, root: str, id: str = "id",
                fanout: int = FANOUT) -> None:
    """Validate one micro-batch and write what it adds to the table as a run of its own.

    The run is named by the batch number, and the batch starts from the rows of earlier versions
    alone, so a batch that runs again after a failure writes the same from the same start, even
    when its first attempt was merged into a longer run already.  References are checked against
    stored and incoming identifiers together, and a row that is appended under a stored
    identifier is reported as its duplicate.
    """
    spark = batch.sparkSession
    batch = materialize(batch)  # row numbers must stay the same for every use
    values = [c for c in batch.columns if c not in ("row_no", "_source")]
    own = batch.select(F.col(id).cast("string").alias("id"))
    stored = load_elements(spark, root, version, _buckets_of(own))
    stored = batch.limit(0) if stored is None else stored
    result = merge_elements(stored, batch, id=id)
    judged = materialize(result.incoming.drop("existing"))
    cells = to_cells(batch.select("row_no", "_source", *[F.col(c).cast("string") for c in values]),
                     "row_no", ["_source"]).withColumnRenamed("header", "field")
    refers = [c for c in values if RULES.get(c, {}).get("kind") == "id_reference"]
    known = None
    if refers:
        asked = batch.select(F.explode(F.array(*[F.col(c).cast("string") for c in refers]))
                             .alias("id")).where("id IS NOT NULL")
        held = load_elements(spark, root, version, _buckets_of(asked))
        known = own if held is None else own.unionByName(
            held.select(F.col(id).cast("string").alias("id")).join(asked, "id", "left_semi"))
    found = validate.field_findings(cells, ["_source"], ids=known)
    again = judged.where("status = 'compatible'").select(
        "_source", F.lit(id).alias("field"), F.lit("duplicate_id").alias("check"),
        F.lit("blocking").alias("severity"), "row_no", F.col(id).cast("string").alias("value"))
    folder = f"{root}/v={version}"
    found.unionByName(again).distinct().write.mode("overwrite").parquet(f"{folder}/findings")
    judged.write.mode("overwrite").parquet(f"{folder}/incoming")
    added = judged.where(F.col("status").isin("new", "compatible")).drop("status")
    _write_run(added.withColumns({_BUCKET: bucket(F.col(id)), _VERSION: F.lit(version)}), root,
               (version, version))
    compact(spark, root, version, fanout)


def start_intake(
    spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, *,
    fmt: str = "csv", options: dict | None = None, files_per_batch: int = 100,
    prepare: Callable[[DataFrame], DataFrame] | None = None, once: bool = False,
):
    """Start the streaming query.  ``prepare`` may reshape a batch before it is merged."""
    stream = (
        spark.readStream.format(fmt).schema(schema)
        .options(**({"header": True, "maxFilesPerTrigger": files_per_batch} | (options or {})))
        .load(source)
        .withColumn("_source", F.col("_metadata.file_path"))
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("row_no", F.struct(
            F.lit(batch_id).alias("version"), F.monotonically_increasing_id().alias("n")))
        merge_batch(prepare(batch) if prepare else batch, batch_id, root)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
