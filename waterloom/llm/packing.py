"""Packing token runs into fixed windows by minimum bin slack over the multiset of lengths.

The lengths 1..capacity are few, whatever the corpus: the planner works on their counts alone.
It takes the longest remaining piece, asks a bitset subset-sum which multiset of the remaining
lengths fills the rest of the window closest, reads the counts back from the bitsets' history,
and repeats that window as often as the counts allow.  Pieces then find their window by their
rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waterloom.llm.common import bound_batches
from waterloom.llm.tokens import default_vocabulary, word_ids
from waterloom.session import materialize

CAPACITY = 4096
END_ID = 2
PIECE = ("doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
         "part int, nth bigint")


def pieces(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, vocabulary: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """Tokens of each document and its end id, cut into runs of at most ``capacity``.

    ``part`` and ``nth`` number the runs of equal length inside a task; ``keep_ids`` adds ``ids``,
    little-endian unsigned 32-bit.  Null texts are empty, so every row has its end id; rows that
    repeat are packed each; a null id stays null.  Extra columns are not read.
    """
    path = vocabulary or default_vocabulary()
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = PIECE.format(id=own.schema["doc_id"].dataType.simpleString())
    end = np.array([end_id], "<u4").tobytes()

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, seen, part = word_ids(path), Counter(), TaskContext.get().partitionId()
        for frame in parts:
            rows = []
            for key, ids in zip(frame["doc_id"], coder.encode(frame["text"].tolist())):
                ids += end
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    run = ids[4 * at:4 * (at + capacity)]
                    n = len(run) // 4
                    rows.append((key, at, n, zlib.crc32(run), total, part, seen[n],
                                 *([run] if keep_ids else [])))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=[
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth",
                *(["ids"] if keep_ids else [])])

    return own.mapInPandas(cut, schema + (", ids binary" if keep_ids else ""))


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Windows that use up ``counts`` of lengths: (times repeated, [(length, times in it)])."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    runs = []
    while lengths:
        top = lengths[-1]
        target = capacity - top
        left[top] -= 1
        reach, history, mask = 1, [], (1 << (target + 1)) - 1
        for i in range(bisect_right(lengths, target) - 1, -1, -1):
            n, k = lengths[i], 1
            most = min(left[n], target // n)
            while most and not reach >> target & 1:
                take = min(k, most)
                wider = (reach | reach << (n * take)) & mask
                if wider != reach:
                    history.append((reach, n, take))
                    reach = wider
                most -= take
                k *= 2
            if reach >> target & 1:
                break
        left[top] += 1
        at, used = reach.bit_length() - 1, Counter({top: 1})
        for before, n, take in reversed(history):
            if not before >> at & 1:
                used[n] += take
                at -= n * take
        times = min(left[n] // m for n, m in used.items())
        for n, m in used.items():
            left[n] -= m * times
            if not left[n]:
                lengths.remove(n)
        runs.append((times, sorted(used.items(), reverse=True)))
    return runs


def seats(runs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Where the pieces of a length go: length, first rank, times in a window, first window,
    first offset; sorted by length and rank."""
    rows, given, window = [], Counter(), 0
    for times, parts in runs:
        offset = 0
        for n, m in parts:
            rows.append((n, given[n], m, window, offset))
            given[n] += m * times
            offset += n * m
        window += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(run: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the written rows of ``pieces``.

    An empty table stays empty.  The driver sees one row per length; the seats it sends back are
    bounded by the capacity, not by the corpus.
    """
    spark = run.sparkSession
    per = run.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("n")).collect()}
    where = spark.sparkContext.broadcast(seats(fill(counts, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = run.join(per.select("part", "length", before.alias("base")), ["part", "length"])

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = where.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        bounds = np.searchsorted(table[:, 0], n, "left"), np.searchsorted(table[:, 0], n, "right")
        row = np.empty(len(n), np.int64)
        for i, (a, b, x) in enumerate(zip(*bounds, r)):
            row[i] = a + np.searchsorted(table[a:b, 1], x, "right") - 1
        t = table[row]
        q = r - t[:, 1]
        return pd.DataFrame({"sequence_id": t[:, 3] + q // t[:, 2],
                             "offset": t[:, 4] + q % t[:, 2] * n})

    out = ranked.withColumn("_seat", seat("length", F.col("base") + F.col("nth")))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(
        ["ids"] if "ids" in run.columns else [])]
    return out.select(*kept, "_seat.sequence_id", "_seat.offset")


def packed(docs: DataFrame, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenise, cut and pack; the cut runs are written once, so ranks cannot change later."""
    return pack(materialize(pieces(docs, capacity=capacity, **options)), capacity)


def sequences(packs: DataFrame) -> DataFrame:
    """Token ids of each window in order, from rows with ``ids``: at most the capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packs.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"))
