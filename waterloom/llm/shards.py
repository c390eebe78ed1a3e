"""Training-order token shards: a keyed permutation gives every sequence a global slot.

The tokens of a task's documents run on, one document after the other, and are cut into sequences
of equal length.  Sequences are numbered without gaps from the counts of all tasks; a balanced
Feistel network over the next even number of bits, walked until it lands below the count,
permutes the numbers.  Slot s lies in shard s // slots at offset (s % slots) * stride, so reading
in training order, or going on from any slot, is one sequential read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waterloom.llm.common import attempt_name, bound_batches, open_store, shared_folder
from waterloom.llm.tokens import default_vocabulary, word_ids
from waterloom.session import materialize

LENGTH = 512
END_ID = 2
PAD_ID = 0
#: Sequences in a shard.
SLOTS = 1 << 15
ROUNDS = 6


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slot of each number below ``n``: a bijection of 0..n-1 chosen by ``key``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def cut(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
        end_id: int = END_ID, pad_id: int = PAD_ID, vocabulary: str | None = None,
        width: int = 2) -> DataFrame:
    """Sequences of ``length`` ids of ``width`` bytes: part, nth, n_tokens, doc_ids, ids_crc32,
    body.

    Each document is its ids and an end id; null and empty texts are the end id alone, null ids
    are listed as null, repeated rows stand again.  Only the last sequence of a task is padded.
    ``doc_ids`` names the documents with a token in the sequence, at most ``length``.
    """
    path = vocabulary or default_vocabulary()
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    stride, cell = length * width, f"<u{width}"
    end = np.array([end_id], cell).tobytes()
    names = ["part", "nth", "n_tokens", "doc_ids", "ids_crc32", "body"]

    def run_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, nth = word_ids(path, width), TaskContext.get().partitionId(), 0
        rest, keys, sizes = b"", None, np.zeros(0, np.int64)  # of the sequence not yet full

        def rows(stream: bytes, count: int, tokens: int) -> pa.RecordBatch:
            ends = np.cumsum(sizes)
            at = np.arange(count) * stride
            lo = np.searchsorted(ends, at, "right")
            hi = np.searchsorted(ends - sizes, at + stride, "left")
            where = np.repeat(lo - np.cumsum([0, *(hi - lo)[:-1]]), hi - lo) + np.arange(
                (hi - lo).sum())
            bodies = [stream[i:i + stride] for i in at.tolist()]
            listed = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *(hi - lo)]), pa.int32()), keys.take(pa.array(where)))
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(count, part), pa.int32()),
                pa.array(np.arange(nth, nth + count), pa.int64()),
                pa.array(np.full(count, tokens), pa.int32()), listed,
                pa.array(list(map(zlib.crc32, bodies)), pa.int64()),
                pa.array(bodies, pa.binary())], names=names)

        for batch in batches:
            ids = [x + end for x in coder.encode(batch["text"].to_pylist())]
            more = batch["doc_id"]
            keys = more if keys is None else pa.concat_arrays([keys, more])
            sizes = np.concatenate([sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
            stream = rest + b"".join(ids)
            count = len(stream) // stride
            if count:
                yield rows(stream, count, length)
            nth += count
            done = count * stride
            ends = np.cumsum(sizes)
            first = int(np.searchsorted(ends, done, "right"))
            sizes = (ends - np.maximum(ends - sizes, done))[first:]
            rest, keys = stream[done:], keys.slice(first)
        if rest:
            n = len(rest) // width
            yield rows(rest + np.full(length - n, pad_id, cell).tobytes(), 1, n)

    return own.mapInArrow(run_on, f"part int, nth bigint, n_tokens int, doc_ids array<{kind}>, "
                                  "ids_crc32 bigint, body binary")


def write_shards(sequences: DataFrame, *, key: int = 1, length: int = LENGTH, width: int = 2,
                 slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Write the shards of ``cut``'s written rows and return the written index in slot order:
    slot, shard, offset, n_tokens, ids_crc32, doc_ids.

    A shard is written by one task in order under a name of its attempt and then renamed; an
    attempt that repeats writes the same bytes.  An empty table has an empty index.
    """
    spark = sequences.sparkSession
    root = folder or shared_folder(spark, "tokens")
    per = sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    base = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row a task
    first = materialize(per.select("part", base.alias("base")))
    stride = length * width

    @F.pandas_udf("binary")
    def squeezed(bodies: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=3).compress
        return pd.Series([pack(b) for b in bodies], dtype=object)

    @F.pandas_udf("bigint")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(np.int64), total, key))

    placed = sequences.join(first, "part").select(
        slot(F.col("base") + F.col("nth")).alias("slot"), "n_tokens", "ids_crc32", "doc_ids",
        squeezed("body").alias("body"))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / slots).cast("bigint"))
    count = max(1, -(-total // slots))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder_ = open_store(root)
        shard, out, temporary = None, None, ""
        unpack = zstandard.ZstdDecompressor().decompress

        def close():
            out.close()
            system.move(temporary, f"{folder_}/shard-{shard:08d}.bin")

        for frame in parts:
            offsets = []
            for s, number, body in zip(frame["slot"], frame["shard"], frame["body"]):
                if number != shard:
                    if out is not None:
                        close()
                    system.create_dir(folder_, recursive=True)
                    shard, temporary = number, f"{folder_}/.{attempt_name()}"
                    out = system.open_output_stream(temporary)
                out.write(unpack(body))
                offsets.append((s % slots) * stride)
            yield frame.assign(offset=offsets)[
                ["slot", "shard", "offset", "n_tokens", "ids_crc32", "doc_ids"]]
        if out is not None:
            close()

    kind = sequences.schema["doc_ids"].dataType.simpleString()
    # the shard is the partition: ranges of slots, known without a sample of the rows
    index = materialize(
        placed.repartitionById(count, F.col("shard").cast("int")).sortWithinPartitions("slot")
        .mapInPandas(write, "slot bigint, shard bigint, offset bigint, n_tokens int, "
                            f"ids_crc32 bigint, doc_ids {kind}"))
    index.shard_root = root
    return index


def read_slots(root: str, start: int, count: int, *, length: int = LENGTH, width: int = 2,
               slots: int = SLOTS) -> Iterator[np.ndarray]:
    """Ids of ``count`` sequences from slot ``start`` on, in training order."""
    system, folder = open_store(root)
    stride, at = length * width, start
    while at < start + count:
        shard, first = divmod(at, slots)
        n = min(slots - first, start + count - at)
        with system.open_input_file(f"{folder}/shard-{shard:08d}.bin") as f:
            raw = f.read_at(n * stride, first * stride)
        yield from np.frombuffer(raw, f"<u{width}").reshape(-1, length)
        at += n


def token_shards(docs: DataFrame, *, key: int = 1, **options) -> DataFrame:
    """Tokenise, number, permute and write; the index of all sequences."""
    sizes = {k: v for k, v in options.items() if k in ("length", "width")}
    return write_shards(materialize(cut(docs, **options), "zstd"), key=key, **sizes)
