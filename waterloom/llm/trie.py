"""Prefix trie of conversations, with totals of every subtree.

A node stands for a sequence of turns that some conversation begins with.  Turns are read as
digests; a running sum of position-bound digests gives every prefix its key, so a conversation of
any length can be cut into slices, and nodes are one aggregation.

Subtree totals are passed up by time-forward processing.  The trie is cut into shards, each a
subtree without the subtrees cut off below it: below nodes that many conversations pass, every
child begins a shard, and so does every depth that is a multiple of ``BLOCK``.  A task sorts the
nodes of its shards by reverse level order (Spark's sort, which spills); each node takes what its
children have sent it from a priority queue, adds it to its own and sends the total to its parent.
The queue is ordered like the nodes and spills sorted runs, so memory does not grow with a shard.
Totals of shard roots go the same way over the tree of shards, and shards that others hang from are
passed once more with those totals.
"""

from __future__ import annotations

import heapq
import os
import struct
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterloom.llm.common import bound_batches
from waterloom.operators.ordered import Sequence
from waterloom.session import materialize

#: A node that more conversations pass has its children cut off: a share of all, this at least.
HEAVY, HEAVY_SHARE = 256, 1024
#: Every depth that is a multiple of this begins new shards.
BLOCK = 4096
#: Messages a queue holds before it spills; runs it reads at once before it merges them.
HELD, RUNS = 200_000, 64
#: Conversations that end in a node are joined to texts of this many ids at a time.
CHUNK = 4096

KEY = ["hi", "lo"]


class SpillingQueue:
    """Messages (-depth, hi, lo, leaves, saved), smallest first; sorted runs go to disk.

    The runs lie in an unnamed file of the task, in the folders Spark gives it for spilled data:
    they are gone when the task ends, and a task that runs again makes them again.
    """

    FORM = struct.Struct("<5q")

    def __init__(self, held: int = HELD, runs: int = RUNS):
        self.held, self.most = max(1, held), max(2, runs)
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (message, number of the run, the rest of it)
        self.spills = 0

    def _read(self, file) -> Iterator[tuple]:
        file.seek(0)
        while block := file.read(self.FORM.size * 1024):
            yield from self.FORM.iter_unpack(block)
        file.close()

    def _write(self, messages) -> None:
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None
        file = tempfile.TemporaryFile(dir=folder)
        for m in messages:
            file.write(self.FORM.pack(*m))
        rest = self._read(file)
        if (m := next(rest, None)) is not None:
            self.spills += 1
            heapq.heappush(self.heads, (m, self.spills, rest))

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            full, self.heap = sorted(self.heap), []
            self._write(full)
            if len(self.heads) > self.most:
                heads, self.heads = self.heads, []
                self._write(heapq.merge(*(self._all(m, rest) for m, _, rest in heads)))

    @staticmethod
    def _all(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
        yield first
        yield from rest

    def take(self, key: tuple) -> tuple[int, int]:
        """Sums of the messages for ``key``, which no message is smaller than."""
        leaves = saved = 0
        while self.heap and self.heap[0][:3] == key:
            m = heapq.heappop(self.heap)
            leaves, saved = leaves + m[3], saved + m[4]
        while self.heads and self.heads[0][0][:3] == key:
            m, number, rest = self.heads[0]
            leaves, saved = leaves + m[3], saved + m[4]
            if (after := next(rest, None)) is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (after, number, rest))
        return leaves, saved

    def __len__(self) -> int:
        return len(self.heap) + len(self.heads)


def forward(held: int = HELD) -> Callable:
    """Time-forward pass for ``mapInPandas`` over rows of the columns ``PASS``, sorted by shard and
    reverse level order: ``leaves`` and ``saved`` become the totals of each node's subtree inside
    its shard.  The up_ columns name the parent, which a shard's root (named like it) has not."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, shard = SpillingQueue(held), None
        for f in frames:
            leaves_out, saved_out = [], []
            for s_hi, s_lo, depth, hi, lo, up_depth, up_hi, up_lo, leaves, saved in zip(
                    *(f[c].tolist() for c in PASS)):
                if shard != (s_hi, s_lo):
                    shard = (s_hi, s_lo)
                    if len(queue):
                        raise RuntimeError("a message has not found its node")
                more = queue.take((-depth, hi, lo))
                leaves, saved = leaves + more[0], saved + more[1]
                if (hi, lo) != shard:
                    queue.push((-up_depth, up_hi, up_lo, leaves, saved))
                leaves_out.append(leaves)
                saved_out.append(saved)
            yield f[PASS[:5]].assign(leaves=pd.Series(leaves_out, dtype="int64", index=f.index),
                                     saved=pd.Series(saved_out, dtype="int64", index=f.index))

    return run


PASS = ["shard_hi", "shard_lo", "depth", "hi", "lo", "up_depth", "up_hi", "up_lo", "leaves",
        "saved"]
PASSED = ("shard_hi bigint, shard_lo bigint, depth bigint, hi bigint, lo bigint, leaves bigint, "
          "saved bigint")


def _pass(df: DataFrame, held: int) -> DataFrame:
    # only a shard's root has no parent, and its names are not read
    rows = df.select(*[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in PASS])
    rows = rows.repartition("shard_hi", "shard_lo")
    order = ["shard_hi", "shard_lo", F.desc("depth"), "hi", "lo"]
    return rows.sortWithinPartitions(*order).mapInPandas(forward(held), PASSED)


def numbered(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn",
             role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1, in the order of the turns), digest and size (bytes of the text).

    Null turns come first, null roles and texts count as empty, rows without a conversation are
    left out.  Turns of equal number are ordered by role, then by their digest; repeated rows are
    turns of their own.
    """
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
        who.alias("role"), F.octet_length(what).cast("bigint").alias("size"),
        F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what)).alias("digest"))
    return Sequence(rows, "conv_id", ["turn", "role", "digest"]).row_number("place").df.select(
        "conv_id", "place", "digest", "size")


def with_shared_openings(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: the first h turns of conversation c - c % every,
    then what c has after its own first h, where h = crc32(c as text) % most.

    Returns the rebuilt turns and a frame of all conversation ids.  At most ``most`` - 1 turns of
    a conversation are copied, to fewer than 2 * ``every`` others.
    """
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % F.lit(most)
    sizes = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    convs = sizes.select("conv_id", h.cast("bigint").alias("h"),
                         (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = materialize(convs.join(bases, "base", "left").select(
        "conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    own = turns.join(convs, "conv_id").where("place > h").withColumn(
        "place", F.col("place") - F.col("h") + F.col("taken"))
    openings = turns.where((F.col("place") < most) & (F.col("conv_id") % every == 0))
    openings = openings.withColumnRenamed("conv_id", "base").join(convs, "base").where("place <= h")
    columns = ["conv_id", "place", "digest", "size"]
    return own.select(*columns).unionByName(openings.select(*columns)), convs.select("conv_id")


def _prefix_rows(turns: DataFrame) -> DataFrame:
    """Every turn with the key of the prefix that ends in it (hi, lo), the key of the prefix
    before (up_hi, up_lo), and whether it is the conversation's last."""
    a, b = (F.xxhash64(F.lit(s), "place", "digest") for s in ("a", "b"))
    low = F.lit((1 << 31) - 1)
    parts = {"s0": a.bitwiseAND(low), "s1": F.shiftright(a, 31).bitwiseAND(low),
             "s2": b.bitwiseAND(low), "s3": F.shiftright(b, 31).bitwiseAND(low)}
    rows = turns.withColumns(parts)
    out = Sequence(rows, "conv_id", "place").compute(
        sums={f"t{i}": F.col(f"s{i}") for i in range(4)}, following={"after": F.col("place")}).df
    so_far = [F.col(f"t{i}") for i in range(4)]
    before = [F.col(f"t{i}") - F.col(f"s{i}") for i in range(4)]
    return out.select("conv_id", F.col("place").alias("depth"), "size", *_key(so_far, "hi", "lo"),
                      *_key(before, "up_hi", "up_lo"), F.col("after").isNull().alias("ends"))


def _key(sums: list[Column], hi: str, lo: str) -> list[Column]:
    return [F.xxhash64(F.lit("hi"), *sums).alias(hi), F.xxhash64(F.lit("lo"), *sums).alias(lo)]


def _root_key() -> list[Column]:
    return _key([F.lit(0).cast("bigint")] * 4, "hi", "lo")


def _sharded(rows: DataFrame, heavy: DataFrame, block: int) -> DataFrame:
    """``rows`` with the key of the shard of each row's node (null: the root's shard)."""
    marked = rows.join(heavy.select(*KEY, F.lit(1).alias("heavy")), KEY, "left")
    # heavy nodes come first on a path, so the first light one has exactly them above it
    cut = (F.col("heavy").isNull() & (F.col("depth") == F.col("above") + 1)) | (
        F.col("depth") % block == 0)
    return Sequence(marked, "conv_id", "depth").compute(sums={"above": F.col("heavy")}).compute(last={
        "shard_hi": F.when(cut, F.col("hi")), "shard_lo": F.when(cut, F.col("lo"))}).df


def joined_ids(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """hi, lo, ends_sha256: SHA-256 of the conv_ids at each key, ascending, with commas between.

    Ids are range-partitioned by key and value, so a key that many conversations end in is dealt
    over many tasks; each joins its ids to texts, and only these pass the one digest in order.
    """

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, out = None, [], []

        def done():
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for f in frames:
            for hi, lo, c in zip(f["hi"].tolist(), f["lo"].tolist(), f["conv_id"].tolist()):
                if key != (hi, lo) or len(ids) >= chunk:
                    done()
                    key = (hi, lo)
                ids.append(c)
            yield pd.DataFrame(out, columns=["hi", "lo", "first", "ids"])
            out.clear()
        done()
        yield pd.DataFrame(out, columns=["hi", "lo", "first", "ids"])

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        key, state = None, None
        for f in frames:
            out = []
            for hi, lo, ids in zip(f["hi"].tolist(), f["lo"].tolist(), f["ids"]):
                if key != (hi, lo):
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (hi, lo), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["hi", "lo", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["hi", "lo", "ends_sha256"])

    dealt = ends.repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id")
    texts = dealt.mapInPandas(join, "hi bigint, lo bigint, first bigint, ids string")
    return texts.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInPandas(
        digest, "hi bigint, lo bigint, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, convs: DataFrame, *, heavy: int | None = None, block: int = BLOCK,
    held: int = HELD, chunk: int = CHUNK,
) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, place, digest, size), all long but the
    digest: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, (n_convs - 1) times the bytes of a
    node's last text) and ends_sha256 of the conversations that end in the node.

    Places run from 1 without gaps in each conversation.  ``convs`` (conv_id, each once) names all
    conversations, those without turns included; these are members of the root alone.  Without
    conversations there is no node.  ``heavy``, ``block``, ``held`` and ``chunk`` only say how the
    work is cut, never what comes out.
    """
    bound_batches(turns.sparkSession)
    rows = materialize(_prefix_rows(turns))
    total = convs.count()
    limit = max(HEAVY, total // HEAVY_SHARE) if heavy is None else heavy
    crowded = materialize(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
                          .where(F.col("n") > limit).select(*KEY))
    members = _sharded(rows, crowded, block)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = root.where("n_convs > 0").select(
        *_root_key(), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs",
        F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("up_hi"),
        F.lit(None).cast("bigint").alias("up_lo"), F.lit(None).cast("bigint").alias("shard_hi"),
        F.lit(None).cast("bigint").alias("shard_lo"))
    plain = members.groupBy(*KEY).agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in (
            "size", "up_hi", "up_lo", "shard_hi", "shard_lo")])
    nodes = plain.unionByName(root).withColumns({
        f"shard_{k}": F.coalesce(f"shard_{k}", r) for k, r in zip(KEY, _root_key())})
    nodes = materialize(nodes)

    kids = materialize(nodes.where("up_hi IS NOT NULL").groupBy("up_hi", "up_lo").agg(
        F.count(F.lit(1)).alias("n_children")).select(
        F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"), "n_children"))
    above = nodes.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"),
                         F.col("conv_id").alias("parent_conv_id"),
                         F.struct("shard_hi", "shard_lo").alias("up_shard"))
    nodes = nodes.join(kids, KEY, "left").join(above, ["up_hi", "up_lo"], "left")
    nodes = materialize(nodes.withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("bigint")),
        "leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint"),
        "up_depth": F.col("depth") - 1, "saved": (F.col("n_convs") - 1) * F.col("size")}))

    passed = materialize(_pass(nodes, held))
    totals = _across(nodes, passed, held)
    ended = rows.where("ends").select(*KEY, "conv_id").unionByName(
        convs.join(rows.where("depth = 1"), "conv_id", "left_anti").select(*_root_key(), "conv_id"))
    ends = materialize(joined_ids(ended, chunk))
    return nodes.join(totals, KEY).join(ends, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("total_leaves").alias("n_leaves"), F.col("total_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def _across(nodes: DataFrame, passed: DataFrame, held: int) -> DataFrame:
    """hi, lo, total_leaves, total_saved of every node, from the totals inside each shard."""
    shard = ["shard_hi", "shard_lo"]
    root = (F.col("hi") == F.col("shard_hi")) & (F.col("lo") == F.col("shard_lo"))
    links = nodes.where(root & F.col("up_hi").isNotNull()).select(*shard, "up_hi", "up_lo", "up_shard")
    local = passed.where(root).select(*shard, "depth", "leaves", "saved")
    links = materialize(local.join(links, shard, "left"))
    inner = materialize(links.where("up_shard IS NOT NULL").select("up_shard.*").distinct())
    # shards that nothing hangs from are final; what they send is added up first
    leaf = links.join(inner, shard, "left_anti").where("up_shard IS NOT NULL")
    sent = materialize(leaf.groupBy("up_hi", "up_lo", "up_shard").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    # one row per shard that others hang from: a tree again, its root the shard of the root
    extra = sent.groupBy("up_shard.shard_hi", "up_shard.shard_lo").agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    tree = links.join(inner, shard, "left_semi").join(extra, shard, "left")
    tree = materialize(tree.select(
        "depth", F.col("shard_hi").alias("hi"), F.col("shard_lo").alias("lo"), "up_shard",
        F.col("up_hi").alias("node_hi"), F.col("up_lo").alias("node_lo"),
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
    depths = tree.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"),
                         F.col("depth").alias("up_depth"))
    rows = tree.select("depth", "hi", "lo", "leaves", "saved", "up_shard.*").withColumnsRenamed(
        {"shard_hi": "up_hi", "shard_lo": "up_lo"}).join(depths, ["up_hi", "up_lo"], "left")
    whole = materialize(_pass(rows.withColumns(
        {f"shard_{k}": r for k, r in zip(KEY, _root_key())}), held))
    sent = sent.select("up_hi", "up_lo", "leaves", "saved").unionByName(
        tree.where("up_shard IS NOT NULL").select("hi", "lo", "node_hi", "node_lo").join(
            whole, KEY).select(F.col("node_hi").alias("up_hi"), F.col("node_lo").alias("up_lo"),
                               "leaves", "saved"))
    sent = materialize(sent.groupBy("up_hi", "up_lo").agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    again = nodes.join(inner, shard, "left_semi").join(
        sent.select(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"), "more_leaves",
                    "more_saved"), KEY, "left")
    again = again.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
                               for c in ("leaves", "saved")})
    final = _pass(again, held)
    out = passed.join(inner, shard, "left_anti").unionByName(final)
    return materialize(out.select("hi", "lo", F.col("leaves").alias("total_leaves"),
                                  F.col("saved").alias("total_saved")))
