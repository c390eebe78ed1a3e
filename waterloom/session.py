"""Session helpers: shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only where the session has none.

    The cluster names its shared folder in ``spark.checkpoint.dir``.  A machine-local
    folder is used in local mode only, where driver and executors share one disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="waterloom-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table under the checkpoint folder and return a frame that reads it.

    Used between rounds of an iteration and wherever a value that depends on the physical
    split (a partition number) has to stay the same for every later use.  A written table
    survives lost executors like a checkpoint does, and it also starts the next round with
    fresh statistics and without the constraints of all earlier rounds, which would otherwise
    pile up in the optimizer.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if open_scopes := _scopes():
        open_scopes[-1].append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame from ``materialize`` that no later plan reads."""
    _delete(df.sparkSession, df.written_to)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_local = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def scratch(fn: Callable) -> Callable:
    """Let ``fn``, which returns one frame or a tuple with frames, clean up after itself.

    Tables it has written are deleted when it returns, but for those the returned frames read, and
    all of them when it fails.  What is left belongs to the scope around it, if there is one.
    """
    @functools.wraps(fn)
    def run(*args, **options):
        scopes = _scopes()
        scopes.append([])
        try:
            out = fn(*args, **options)
            frames = [f for f in (out if isinstance(out, tuple) else (out,)) if isinstance(f, DataFrame)]
            read = "\n".join(f for frame in frames for f in frame.inputFiles())
        except BaseException:
            read = ""
            raise
        finally:
            written = scopes.pop()
            kept = [p for p in written if p.rsplit("/", 1)[1] in read]
            for path in written:
                if path not in kept:
                    _delete(SparkSession.active(), path)
            if scopes:
                scopes[-1].extend(kept)
        return out

    return run
