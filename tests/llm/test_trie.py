"""The prefix trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from waterloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            size = len(r.encode())
            digest = hashlib.md5(f"{size}:{r}{x}".encode()).hexdigest()
            own.setdefault(c, []).append(((t is not None, t), r, digest, x))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    member, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            member.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in member:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k in member:
        cost = (len(member[k]) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
            saved[k[:d]] = saved.get(k[:d], 0) + cost
    return sorted((min(m), len(k), min(member[k[:-1]]) if k else None, len(m), kids.get(k, 0),
                   leaves[k], saved[k], hashlib.sha256(",".join(
                       map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
                  for k, m in member.items())


def nodes(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("hi", "depth", "place", "shard_hi", "n"):  # names that the operator uses itself
        df = df.withColumn(name, F.lit("x"))
    turns, convs = trie.with_shared_openings(trie.numbered(df))
    return nodes(trie.prefix_trie(turns, convs, **more))


def talk(n, seed=1, words=3, most=9):
    rnd = random.Random(seed)
    return [(c, t, "user" if t % 2 else "assistant", f"ä{rnd.randrange(words)}" * rnd.randrange(1, 3))
            for c in range(-20, n) if c % 7 for t in range(rnd.randrange(1, most))]


def odd_rows():
    return [(None, 1, "user", "lost"), (400, None, "user", "first"), (400, 0, None, None),
            (400, 0, "", ""), (400, 2, "b", "tie"), (400, 2, "a", "tie"), (400, 2, "a", "tie"),
            (401, 3, "user", None), (402, 1, "user", "x" * 5000), (403, None, None, None),
            (1001, 1, "user", "gone when h is large"), (1002, 1, "user", "too")]


@pytest.mark.parametrize("cut", [{}, {"heavy": 3, "block": 2, "held": 2, "chunk": 2},
                                 {"heavy": 0, "block": 1}, {"heavy": 10 ** 6, "block": 10 ** 6}])
def test_equals_dictionaries_however_the_work_is_cut(spark, cut):
    rows = talk(150) + odd_rows()
    assert run(spark, rows, **cut) == plain(rebuilt(rows))


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 400, 5) for t in range(4)]
    rows += [(2000 + c, 0, "user", f"other {c}") for c in range(0, 90, 5)]
    assert run(spark, rows, heavy=8, chunk=16) == plain(rebuilt(rows))


def test_a_long_conversation_and_those_that_grow_along_it(spark):
    turns = {c: [("u", f"t{i}") for i in range(n)] for c, n in enumerate((400, 1, 2, 3, 57, 400, 399))}
    rows = [(c, i + 1, hashlib.md5(repr(t).encode()).hexdigest(), len(t[1]))
            for c, ts in turns.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, place long, digest string, size long")
    convs = spark.createDataFrame([(c,) for c in [*turns, 99]], "conv_id long")
    for cut in ({"heavy": 2, "block": 16, "held": 3}, {"heavy": 1, "block": 100}):
        assert nodes(trie.prefix_trie(df, convs, **cut)) == plain(turns | {99: []})


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_queue_spills_and_merges_runs():
    rnd = random.Random(5)
    queue = trie.SpillingQueue(held=4, runs=3)
    want = {}
    for _ in range(500):
        key = (-rnd.randrange(9), rnd.randrange(5), rnd.randrange(5))
        want.setdefault(key, [0, 0])
        want[key][0] += 1
        want[key][1] += 7
        queue.push((*key, 1, 7))
    assert queue.spills > 20
    assert [queue.take(k) for k in sorted(want)] == [tuple(want[k]) for k in sorted(want)]
    assert len(queue) == 0
