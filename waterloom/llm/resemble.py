"""Near duplicates by the Jaccard similarity of five-word shingles.

SimHash comes first: fingerprints of the same shingles are linked as op1 links its own (pigeonhole
blocks, at most two bits apart), and the links that the exact similarity confirms connect the
closest copies.  It does not reach all: at a similarity of 0.8 two 64-bit fingerprints differ in
more bits than blocks can be spared.  MinHash tells which other texts may have a partner: ``BANDS``
bands of ``ROWS`` minima each, so a pair of similarity J is missed with probability (1 - J ** ROWS)
** BANDS, which is 4e-7 at 0.8 and less above.  Texts of equal shingle sets are one member.

Among the texts that share a band with another, candidates are exact.  Their shingles are put in
one order, those that fewest texts have first.  Of two sets with a similarity of 0.8, each has a
shared shingle among its first fifth (and one), so only these meet; a line that thousands of texts
share comes last in all of them and gathers nobody.  Where two sets meet, what is left of both from
there on must still suffice, else they part.  In a bucket all members are held against the one
that has least before it; that connects a crowd of copies at once.  What is still apart in a
bucket, and only that, is held against its other members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterloom.llm import simhash
from waterloom.llm.common import bound_batches, fresh, hash_filter, with_filter
from waterloom.operators.graph import components
from waterloom.session import discard, materialize, scratch

SHINGLE = 5
#: Least similarity of near duplicates, as a fraction so that it is compared in whole numbers.
LEAST, OF = 4, 5
ROWS = 4
BANDS = 28
CHUNK = 2048


def _constants() -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x[::2, None], x[1::2, None] | np.uint64(1)


FLIP, FACTOR = _constants()


def shingles_of(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted different XXH64 hashes of the text's shingles; fewer words than a shingle: the hash
    of them all."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w))], np.uint64)
    joined = map(b" ".join, zip(*(islice(w, i, None) for i in range(words))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(0)), np.uint64,
                                 len(w) - words + 1))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A key of each band; none for a text without words."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, ((shingles[None, at:at + CHUNK] ^ FLIP) * FACTOR).min(axis=1), out=least)
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(ROWS, BANDS):
        out = (out ^ (row >> np.uint64(29)) ^ row) * np.uint64(0xD6E8FEB86659FD93)
    return out.view(np.int64)


def fingerprint_of(shingles: np.ndarray) -> int:
    """op1's fingerprint, of a set of shingles; zero for a text without words."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), simhash.CHUNK):
        ones += simhash.bits_set(shingles[at:at + simhash.CHUNK])
    return simhash.majority(ones, len(shingles))


def sketch(text: Column | str) -> Column:
    """``same`` (digest of the shingle set), ``size``, fingerprint ``fp`` and the keys of the
    ``bands``."""
    bound_batches()

    @F.pandas_udf("struct<same:binary,size:int,fp:bigint,bands:array<bigint>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for part in parts:
            sets = [shingles_of(t) for t in part]
            yield pd.DataFrame({
                "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "size": np.array([len(s) for s in sets], np.int32),
                "fp": np.array([fingerprint_of(s) for s in sets], np.int64),
                "bands": [bands_of(s) for s in sets]})

    return of(text)


def shingles(text: Column | str) -> Column:
    bound_batches()

    @F.pandas_udf("array<bigint>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([shingles_of(t).view(np.int64) for t in part], dtype=object)

    return of(text)


def _may(a: str, b: str) -> Column:
    """Whether two members (structs of same, size, pos) that share the shingle at ``pos`` as their
    first can be similar: a + b sizes, and what follows the shingle, allow LEAST / OF."""
    small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    rest = F.least(F.col(f"{a}.size") - F.col(f"{a}.pos"), F.col(f"{b}.size") - F.col(f"{b}.pos"))
    return (OF * small >= LEAST * large) & (
        (LEAST + OF) * rest >= LEAST * (F.col(f"{a}.size") + F.col(f"{b}.size")))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.same", f"{b}.same").alias("a"),
            F.greatest(f"{a}.same", f"{b}.same").alias("b")]


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("same").alias("a"), F.col("set").alias("set_a")), "a")
    both = both.join(sets.select(F.col("same").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    # common / (a + b - common) >= LEAST / OF
    return both.where((LEAST + OF) * common >= LEAST * (F.size("set_a") + F.size("set_b"))).select(
        "a", "b")


def fingerprint_links(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``same`` that connect members whose fingerprints ``simhash.links`` connects.

    The least member stands for a fingerprint; others that have it are paired with that one.
    """
    fps = materialize(members.groupBy("fp").agg(F.min("same").alias("first")))

    def first(end: str) -> DataFrame:
        return fps.select(F.col("fp").alias(end), F.struct(F.col("first").alias("same")).alias(
            f"{end}_m"))

    apart = materialize(simhash.links(fps.select("fp"))).join(first("a"), "a").join(first("b"), "b")
    twins = members.select("fp", "same").join(fps, "fp").where("same != first")
    return materialize(apart.select(*_ordered("a_m", "b_m")).unionByName(
        twins.select(F.col("first").alias("a"), F.col("same").alias("b"))))


def _sets(docs: DataFrame, members: DataFrame, text: str, told: DataFrame) -> DataFrame:
    """same, size and shingle set of the members that share a band with another member, or that
    stand in a pair of ``told``."""
    keyed = members.select("same", F.posexplode("bands").alias("band", "key"))
    shared = materialize(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
                         .where("n > 1").select("band", "key"))
    busy = keyed.join(shared, ["band", "key"], "left_semi").select("same")
    busy = materialize(busy.unionByName(told.select(F.explode(F.array("a", "b")).alias(
        "same"))).distinct())
    wanted = materialize(members.join(busy, "same", "left_semi").select("same", "size", "text_hash"))
    texts = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    # most texts have no partner: they are not moved to find that out
    texts = with_filter(texts, hash_filter(wanted, "text_hash"), "text_hash", "busy").where("busy")
    texts = texts.join(wanted, "text_hash").groupBy("same", "size").agg(
        F.first("text").alias("text"))
    return materialize(texts.select("same", "size", shingles("text").alias("set")))


def _first_shingles(sets: DataFrame) -> DataFrame:
    """shingle and member (same, size, pos) for the first fifth (and one) of each set, rarest
    first; shingles that no other set has are counted in ``pos`` and left out."""
    rows = sets.select("same", "size", F.explode("set").alias("shingle"))
    counts = materialize(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    mine = Window.partitionBy("same")
    placed = rows.join(counts, "shingle").select(
        "same", "size", "shingle", F.count(F.lit(1)).over(mine).alias("common"),
        F.row_number().over(mine.orderBy("n", "shingle")).alias("rank"))
    pos = F.col("size") - F.col("common") + F.col("rank") - 1
    return materialize(placed.where(OF * pos <= (OF - LEAST) * F.col("size")).select(
        "shingle", F.struct("same", "size", pos.alias("pos")).alias("m")))


def links(sets: DataFrame, told: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``same`` that connect all members of similarity 0.8 and more; those of
    ``told`` are compared first."""
    first = _first_shingles(sets)
    lead = F.struct("m.pos", "m.same", "m.size")
    buckets = materialize(first.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min(lead).alias("lead")).where("n > 1").drop("n"))
    met = first.join(buckets, "shingle").where(F.col("m.same") != F.col("lead.same"))
    stars = met.where(_may("m", "lead")).select(*_ordered("m", "lead")).distinct()
    stars = materialize(stars.join(told, ["a", "b"], "left_anti"))
    near = materialize(_alike(told.unionByName(stars), sets))
    group = materialize(components(near, "a", "b"))
    parts = first.join(buckets, "shingle", "left_semi").withColumn("node", F.col("m.same"))
    parts = materialize(parts.join(group, "node", "left").select(
        "shingle", "m", F.coalesce("component", "node").alias("c")))
    # buckets that are still apart: the largest part, and the members outside it
    sizes = parts.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("n"))
    apart = materialize(sizes.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "c")).alias("most"))
        .where("parts > 1").select("shingle", F.col("most.c").alias("top")))
    left = materialize(parts.join(apart, "shingle"))
    outside = materialize(left.where("c != top").select("shingle", F.col("m").alias("o"),
                                                        F.col("c").alias("d")))
    more = left.join(outside, (left["shingle"] == outside["shingle"]) & (F.col("c") != F.col("d"))
                     & ((F.col("c") == F.col("top")) | (F.col("m.same") < F.col("o.same")))
                     & _may("m", "o")).select(*_ordered("m", "o")).distinct()
    more = materialize(more.join(told.unionByName(stars), ["a", "b"], "left_anti"))
    return near.unionByName(_alike(more, sets))


@scratch
def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, and ``component``, equal for documents that a chain
    of near duplicates connects.  Texts without words are copies of each other."""
    own = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        sketch(text).alias("s")).select("doc_id", "text_hash", "s.*"))
    members = materialize(own.groupBy("same").agg(
        F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"),
        F.min("text_hash").alias("text_hash")))
    # the bands lie twice on disk now, and not at all once the sets are known
    sketched, own = own, materialize(own.select("doc_id", "text_hash", "same"))
    discard(sketched)
    told = fingerprint_links(members)
    sets = _sets(docs, members, text, told)
    discard(members)
    group = materialize(components(materialize(links(sets, told)), "a", "b"))
    return own.select("doc_id", "text_hash", "same").join(
        group.withColumnRenamed("node", "same"), "same", "left").select(
        "doc_id", "text_hash", F.coalesce("component", "same").alias("component"))


@scratch
def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest id.

    Rows are told apart by id and text, so two texts of one id do not go together; rows that
    repeat the kept one are reduced to one.  Rows without an id stay.  All columns are kept.
    """
    rows = materialize(near_duplicates(docs, doc_id=doc_id, text=text).where("doc_id IS NOT NULL")
                       .groupBy("component", "doc_id", "text_hash").agg(
                           F.count(F.lit(1)).alias("n")))
    kept = materialize(rows.groupBy("component").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("k")))
    own_hash = fresh(docs, "text_hash")
    names = [F.col("doc_id").alias(f"{own_hash}_id"), F.col("text_hash").alias(f"{own_hash}_of")]
    told = rows.join(kept, "component").withColumn("is", F.struct("doc_id", "text_hash"))
    gone = materialize(told.where("is != k").select(*names))
    twice = materialize(told.where("is = k AND n > 1").select(*names))
    keyed = docs.withColumn(own_hash, F.xxhash64(text))

    def among(df, other, how):
        return df.join(other, (df[doc_id] == other[f"{own_hash}_id"])
                       & (df[own_hash] == other[f"{own_hash}_of"]), how)

    # only documents whose text may be one of those that go are moved to be looked up
    maybe = fresh(keyed, "maybe")
    keyed = with_filter(keyed, hash_filter(gone, f"{own_hash}_of"), own_hash, maybe)
    left = keyed.where(~F.col(maybe)).unionByName(
        among(keyed.where(maybe), gone, "left_anti")).drop(maybe)
    if twice.isEmpty():
        return left.drop(own_hash)
    once = among(left, twice, "left_semi").dropDuplicates([doc_id, own_hash])
    return among(left, twice, "left_anti").unionByName(once).drop(own_hash)
