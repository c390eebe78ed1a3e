"""SimHash fingerprints and near-duplicate groups by pigeonhole blocks.

Two fingerprints that differ in at most ``distance`` bits agree in all but ``distance`` of any
blocks the bits are cut into, so they meet in the bucket of the blocks they agree in; a bucket's
pairs are verified by their Hamming distance.  Only different fingerprints enter buckets, so exact
copies cost nothing there.  A bucket with more than ``FULL`` fingerprints is not paired: its
fingerprints can only differ in the bits outside its blocks, so each is sent to itself and to its
one-bit neighbours among those, and fingerprints that meet at one place differ in two bits or
fewer.  Such a place has one fingerprint per bit at most, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterloom.llm.common import bound_batches, fresh
from waterloom.operators.graph import components
from waterloom.session import materialize

SHINGLE = 3
SEED = 42
DISTANCE = 2
BLOCKS = 5
FULL = 32
CHUNK = 1 << 16


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of their 64 bits set."""
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """Fingerprint of ``n`` hashes from the counts of their bits."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_of(text: str | None, words: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the XXH64 hashes of the text's shingles."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        shingles, n = iter([b" ".join(w)]), 1
    else:
        shingles = map(b" ".join, zip(*(islice(w, i, None) for i in range(words))))
        n = len(w) - words + 1
    ones = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for at in range(0, n, CHUNK):
        ones += bits_set(np.fromiter(islice(hashes, CHUNK), "<u8", min(CHUNK, n - at)))
    return majority(ones, n)


def fingerprint(text: Column | str) -> Column:
    """64-bit fingerprint (bigint).  Null, empty and white-space texts: zero; fewer words than a
    shingle: the hash of them all.  Works through long texts in chunks."""
    bound_batches()

    @F.pandas_udf("bigint")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([fingerprint_of(t) for t in part], dtype="int64")

    return of(text)


def as_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks(blocks: int, distance: int) -> list[int]:
    cut = [round(i * 64 / blocks) for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    masks = [sum(c) for c in combinations(bits, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, *, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a, b) of different ``fp`` values that connect all fingerprints at most ``distance``
    (1 or 2) bits apart: every link found in a bucket, stars in the buckets that are too full.

    ``fps`` holds each fingerprint once.  An empty table gives no pairs.
    """
    if not 1 <= distance <= 2:
        raise ValueError("distance must be 1 or 2")
    rows = [F.struct(F.lit(i).alias("blocks"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket"))
            for i, m in enumerate(_masks(blocks, distance))]
    keyed = fps.select("fp", F.explode(F.array(*rows)).alias("k")).select("fp", "k.*")
    key = ["blocks", "bucket"]
    # written, so that the joins below know its size and skewed sides can be split
    full = materialize(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
                       .where(F.col("n") > FULL).select(*key))
    members = keyed.join(full, key, "left_anti").groupBy(*key).agg(F.collect_list("fp").alias("m"))
    pairs = members.where(F.size("m") > 1).select("m", F.explode("m").alias("a"))
    pairs = pairs.select("a", F.explode("m").alias("b")).where(
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    free = F.element_at(F.array(*[F.lit(~m) for m in _masks(blocks, distance)]),
                        F.col("blocks") + 1)
    rest = keyed.join(full, key, "left_semi").select("fp", free.alias("free"))
    near = rest.select("fp", F.explode(F.expr(
        "concat(array(fp), transform(filter(sequence(0, 63), i -> (free & shiftleft(1L, i)) != 0),"
        " i -> fp ^ shiftleft(1L, i)))")).alias("place")).distinct()
    if distance == 1:  # then only a fingerprint's own place may gather its neighbours
        near = near.join(fps.select(F.col("fp").alias("place")), "place", "left_semi")
        centre = F.col("place")
    else:
        centre = F.col("least")
    stars = near.groupBy("place").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
    stars = stars.select("place", F.array_min("m").alias("least"), F.explode("m").alias("fp"))
    stars = stars.select(F.least(centre, "fp").alias("a"), F.greatest(centre, "fp").alias("b"))
    return pairs.unionByName(stars.where("a < b")).distinct()


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE,
) -> DataFrame:
    """One row per document: doc_id, fp, fingerprint, component_id (smallest doc_id it reaches).

    Null ids have a fingerprint and a component but never name one; a component of null ids alone
    is null.  Repeated rows stay repeated.  An empty table gives no rows.
    """
    own = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text).alias("fp")))
    fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = materialize(components(links(fps.select("fp"), distance=distance), "a", "b"))
    joined = linked.select(F.col("node").alias("fp"), "component")
    # written: each of the last two joins then has a plain table on the small side
    named = materialize(joined.join(fps, "fp").groupBy("component").agg(
        F.min("first_id").alias("component_id")))
    moved = materialize(joined.join(named, "component").select("fp", "component_id"))
    labels = materialize(fps.join(moved, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return own.join(labels, "fp").select(
        "doc_id", "fp", as_hex("fp").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one whose id names the component.

    Rows that repeat the kept id are reduced to one.  Rows without an id cannot be told apart by
    id and stay.  All columns are kept.
    """
    labelled = materialize(near_duplicates(docs, doc_id=doc_id, text=text)
                           .where(F.col("doc_id").isNotNull()).select("doc_id", "component_id"))
    key = fresh(docs, "dropped")
    gone = materialize(labelled.where(F.col("doc_id") != F.col("component_id"))
                       .select(F.col("doc_id").alias(key)).distinct())
    left = docs.join(gone, docs[doc_id] == gone[key], "left_anti")
    twice = materialize(labelled.where(F.col("doc_id") == F.col("component_id"))
                        .groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key))
    if twice.isEmpty():
        return left
    once = left.join(twice, left[doc_id] == twice[key], "left_semi").dropDuplicates([doc_id])
    return left.join(twice, left[doc_id] == twice[key], "left_anti").unionByName(once)
