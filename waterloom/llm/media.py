"""Payloads as media in content-addressed tar shards, and columns read back from them.

A text's bytes are padded to whole rows of ``ROW`` samples and stored as an 8-bit greyscale image
(PNG, lossless).  Each task appends what it has not yet stored to a tar shard of its own in the
shared folder, under the digest of the stored bytes; a row carries digest, shard, offset and
length.  A payload is stored once per shard however many rows have it.  The index is written
before anything reads it, so only shards of tasks that ended are ever referred to.
"""

from __future__ import annotations

import hashlib
import io
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterloom.llm.common import attempt_name, bound_batches, open_store, shared_folder
from waterloom.session import materialize

ROW = 576
FILL = 255
#: A shard is closed when it has this many bytes.
SHARD_BYTES = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and image header: all that a header-only read fetches.
HEADER_BYTES = 33
SLICE = 4096  # image rows compressed at a time


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([FILL]) * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """PNG of ``ROW`` samples a line, without line filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    packer, out = zlib.compressobj(6), [SIGNATURE, _chunk(b"IHDR", head)]
    for at in range(0, len(rows), SLICE):
        part = rows[at:at + SLICE]
        lines = np.zeros((len(part), ROW + 1), np.uint8)
        lines[:, 1:] = part
        if data := packer.compress(lines.tobytes()):
            out.append(_chunk(b"IDAT", data))
    return b"".join([*out, _chunk(b"IDAT", packer.flush()), _chunk(b"IEND", b"")])


def image_header(head: bytes) -> tuple[str, int, int, int]:
    """Kind, width, height and bits of a sample from the first bytes of the media."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return "image/png", width, height, bits


def decode_image(media: bytes) -> bytes:
    """Samples of an unfiltered 8-bit greyscale PNG; the checksums of its chunks are verified."""
    _, width, height, _ = image_header(media)
    at, unpack, lines = 8, zlib.decompressobj(), []
    while at < len(media):
        size = struct.unpack(">I", media[at:at + 4])[0]
        kind, data = media[at + 4:at + 8], media[at + 8:at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size:at + 12 + size])[0]:
            raise ValueError("damaged media")
        if kind == b"IDAT":
            lines.append(unpack.decompress(data))
        at += 12 + size
    rows = np.frombuffer(b"".join(lines), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """64 bits: which of 64 equal spans of samples are brighter than the next; 16 hex digits."""
    spans = np.frombuffer(payload, np.uint8).reshape(64, -1).mean(axis=1)
    bits = spans > np.roll(spans, -1)
    return np.packbits(bits).tobytes().hex()


def store(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every row's payload and return the written index: doc_id, n_bytes, digest, shard,
    offset, length, part.

    Null and empty texts are a payload of padding; null ids stay null; repeated rows have one
    entry each that name one place.  Extra columns are not read.  An empty table has an empty
    index and no shard.
    """
    spark = docs.sparkSession
    root = folder or shared_folder(spark, "media")
    bound_batches(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_store(root)
        places, out, name, at = {}, None, "", 0
        part = TaskContext.get().partitionId()
        for frame in parts:
            rows = []
            for key, t in zip(frame["doc_id"], frame["text"]):
                payload = payload_of(t)
                n = len((t or "").encode("utf-8", "surrogatepass"))
                known = hashlib.sha256(payload).digest()
                if known not in places:
                    media = encode_image(payload)
                    digest = hashlib.sha256(media).hexdigest()
                    if out is not None and at >= shard_bytes:
                        out.write(b"\0" * 1024)
                        out.close()
                        out = None
                    if out is None:
                        system.create_dir(base, recursive=True)
                        name, at = f"shard-{attempt_name()}.tar", 0
                        out = system.open_output_stream(f"{base}/{name}")
                    entry = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                    entry.size = len(media)
                    head = entry.tobuf(tarfile.GNU_FORMAT)
                    out.write(head + media + b"\0" * (-len(media) % 512))
                    places[known] = (digest, name, at + len(head), len(media))
                    at += len(head) + len(media) + -len(media) % 512
                rows.append((key, n, *places[known], part))
            yield pd.DataFrame(rows, columns=[
                "doc_id", "n_bytes", "digest", "shard", "offset", "length", "part"])
        if out is not None:
            out.write(b"\0" * 1024)  # end of archive
            out.close()

    index = materialize(own.mapInPandas(
        write, f"doc_id {kind}, n_bytes bigint, digest string, shard string, offset bigint, "
               "length bigint, part int"))
    index.media_root = root
    return index


def _by_shard(index: DataFrame) -> DataFrame:
    """Rows of a shard together and in order of place, so that a task reads shards forwards."""
    tasks = index.agg(F.count_distinct("part")).first()[0]
    return index.repartitionByRange(max(1, tasks), "part").sortWithinPartitions(
        "part", "shard", "offset")


class Reader:
    """Ranges of shards, one shard open at a time."""

    def __init__(self, root: str):
        self.system, self.base = open_store(root)
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.system.open_input_file(f"{self.base}/{shard}")
        return self.file.read_at(length, offset)


def headers(index: DataFrame, root: str) -> DataFrame:
    """The index with ``kind``, ``width``, ``height`` and ``bits``, from header-only range reads."""

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(root)
        for frame in parts:
            rows = [image_header(reader.read(s, int(o), HEADER_BYTES))
                    for s, o in zip(frame["shard"], frame["offset"])]
            extra = pd.DataFrame(rows, columns=["kind", "width", "height", "bits"],
                                 index=frame.index)
            yield pd.concat([frame, extra], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return _by_shard(index).mapInPandas(
        fill, f"{schema}, kind string, width bigint, height bigint, bits int")


def read_back(index: DataFrame, root: str) -> DataFrame:
    """Per row of the index what its stored bytes say: payload size and digest, checksum of the
    last 32 samples, media size and digest, feature.  Rows that share a place are read once."""

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, last, values = Reader(root), None, ()
        for frame in parts:
            rows = []
            for key, n, shard, offset, length in zip(
                    frame["doc_id"], frame["n_bytes"], frame["shard"], frame["offset"],
                    frame["length"]):
                if (shard, offset) != last:
                    media = reader.read(shard, int(offset), int(length))
                    payload = decode_image(media)
                    values = (len(payload), hashlib.sha256(payload).hexdigest(),
                              zlib.crc32(payload[-32:]), len(media),
                              hashlib.sha256(media).hexdigest(), feature_of(payload))
                    last = (shard, offset)
                rows.append((key, n, *values))
            yield pd.DataFrame(rows, columns=[
                "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
                "media_bytes", "media_sha256", "feature"])

    kind = index.schema["doc_id"].dataType.simpleString()
    return _by_shard(index).mapInPandas(
        measure, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, "
                 "tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def members(data: bytes) -> list[str]:
    """Names in a shard, as any tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return tar.getnames()
