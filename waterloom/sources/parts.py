"""Files written byte for byte, part by part: a Spark data source for texts of any size.

Rows are (file, part, value): values of one file and part that come one after the other are one
part, stored as ``<folder>/<file>/part-<part>-<mark>``; the parts of a folder, in the order of their
names, concatenate to the file.  Nothing is added: no line end, no encoding.

Every part that is written gets a mark of its own, so a task that runs again, or twice at once,
writes beside what an earlier attempt has left and never onto it.  The commit knows the parts of
the attempts that count, removes all others and lists the kept ones in ``parts.json``; before the
commit there is no list, and a job that fails removes what it has written.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "file string, part string, value binary"
LIST = "parts.json"


def open_folder(uri: str):
    """pyarrow file system and path of a folder that driver and executors reach."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    """Parts of one task: (file, part, name, bytes)."""

    parts: list


class PartFiles(DataSource):
    """``df.write.format("part_files").mode("append").save(folder)``; the folder must be new."""

    @classmethod
    def name(cls) -> str:
        return "part_files"

    def writer(self, schema, overwrite: bool) -> "PartWriter":
        names = [f.name for f in schema]
        if names != ["file", "part", "value"]:
            raise ValueError(f"columns must be {SCHEMA}, not {names}")
        return PartWriter(self.options["path"])


class PartWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_folder(self.folder)
        done, stream, key = [], None, None

        def close():
            if stream is not None:
                stream.close()

        try:
            for batch in iterator:
                columns = (batch.column(c).to_pylist() for c in ("file", "part", "value"))
                for file, part, value in zip(*columns):
                    if key != (file, part):
                        close()
                        key = (file, part)
                        path = posixpath.join(root, file, f"part-{part}-{uuid.uuid4().hex}")
                        done.append([file, part, path, 0])
                        store.create_dir(posixpath.dirname(path), recursive=True)
                        stream = store.open_output_stream(path)
                    stream.write(value or b"")
                    done[-1][3] += len(value or b"")
            close()
        except BaseException:
            close()
            _remove(store, [d[2] for d in done])
            raise
        return Written([(f, p, posixpath.relpath(path, root), n) for f, p, path, n in done])

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = open_folder(self.folder)
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        kept = {posixpath.join(root, name) for _, _, name, _ in parts}
        store.create_dir(root, recursive=True)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        _remove(store, [i.path for i in found if i.is_file and i.path not in kept])
        with store.open_output_stream(posixpath.join(root, LIST)) as out:
            for file, part, name, size in parts:
                line = json.dumps({"file": file, "part": part, "name": name, "bytes": size})
                out.write(line.encode() + b"\n")

    def abort(self, messages) -> None:
        store, root = open_folder(self.folder)
        _remove(store, [posixpath.join(root, name) for m in messages if m is not None
                        for _, _, name, _ in m.parts])


def _remove(store, paths: list[str]) -> None:
    for p in paths:
        try:
            store.delete_file(p)
        except FileNotFoundError:
            pass


def write_parts(rows: DataFrame, folder: str) -> None:
    """Store rows (file, part, value) as they come: the order inside each Spark partition counts."""
    rows.sparkSession.dataSource.register(PartFiles)
    rows.select("file", "part", "value").write.format("part_files").mode("append").save(folder)


def list_parts(spark: SparkSession, folder: str) -> DataFrame:
    """What a finished job has written: file, part, name (inside the folder), bytes."""
    return spark.read.schema("file string, part string, name string, bytes bigint").json(
        f"{folder}/{LIST}")


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored files, one row per part: file, part, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "part-*").load(folder)
    # a part's name is unique by its mark, so the last piece of a path finds its row
    name = F.element_at(F.split("name", "/"), -1).alias("_name")
    listed = list_parts(spark, folder).select(name, "file", "part")
    content = found.select(F.element_at(F.split("path", "/"), -1).alias("_name"), "content")
    return listed.join(content, "_name", "left").select(  # a scan leaves empty parts out
        "file", "part", F.coalesce("content", F.lit(b"")).alias("content"))


def below_common_folder(files: DataFrame, file: str = "file") -> DataFrame:
    """``files`` (paths as Spark's scans name them) with ``target``: each path, its percent escapes
    undone, below the folder that all of them share.

    The longest beginning that the first and the last path in order share, all paths share.
    """
    ends = files.agg(F.min(file).alias("a"), F.max(file).alias("b")).first()
    a, b = ends["a"] or "", ends["b"] or ""
    common = posixpath.commonprefix([a, b])
    cut = common.rfind("/") + 1
    rest = F.substring(file, F.lit(cut + 1), F.length(file))
    plain = F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    return files.withColumn("target", F.coalesce(plain, rest))
