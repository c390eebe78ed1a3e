"""What the operators share: table access, id splits, bound expressions, shared files, row batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterloom.session import ensure_checkpoint_dir, materialize

#: Texts handled together inside a task, in characters; bounds a task's memory, not the result.
GROUP_CHARS = 1_000_000
#: Rows a Python worker gets at a time: texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % F.lit(modulus)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain reference may be inlined by the optimizer into a lambda and then be computed again for
    every element; a lambda variable never is.
    """
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{stem}{n}"
    return name


def bound_batches(spark: SparkSession | None = None) -> None:
    """Let Python workers get at most ``BATCH_ROWS`` rows at a time, if that is less than now.

    The session's own bound in bytes holds as well; results do not depend on either.
    """
    conf = (spark or SparkSession.active()).conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


#: Bits of a filter of hashes: 4 MB however many hashes there are, in bitmaps of 32,768 bits.
FILTER_BITS, BITMAP_BITS = 1 << 25, 1 << 15


def hash_filter(hashes: DataFrame, column: str) -> DataFrame:
    """Bitmaps that have a bit set for every hash: at most ``FILTER_BITS`` bits in all."""
    slot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    return materialize(hashes.groupBy(F.floor(slot / BITMAP_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(slot % BITMAP_BITS).alias("bits")))


def with_filter(df: DataFrame, bitmaps: DataFrame, hashed: str, name: str) -> DataFrame:
    """``df`` with ``name``: false only where the hash is surely none of the filter's.

    The filter is broadcast (its size is bounded), so rows that a join would only throw away, or
    only keep, need not be moved for it; with very many hashes more rows are, never fewer."""
    bucket, bits = fresh(df, "bucket"), fresh(df, "bits")
    slot = F.pmod(F.col(hashed), F.lit(FILTER_BITS))
    joined = df.withColumn(bucket, F.floor(slot / BITMAP_BITS)).join(F.broadcast(
        bitmaps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))), bucket, "left")
    at = slot % BITMAP_BITS
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    bit = F.call_function("shiftright", byte.cast("int"), (at % 8).cast("int"))
    return joined.withColumn(name, F.coalesce(bit.bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop(
        bucket, bits)


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def open_store(uri: str):
    """pyarrow file system and path of a folder every executor reaches (file, HDFS, S3, GCS ...)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def attempt_name() -> str:
    """Distinguishes the files of two attempts at one task; outside tasks any new name."""
    task = TaskContext.get()
    tail = uuid.uuid4().hex[:8]
    return tail if task is None else f"{task.partitionId():06d}-{task.taskAttemptId()}-{tail}"


def groups(texts, limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of at most ``limit`` characters, or of one longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
