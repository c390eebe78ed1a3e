"""Vector codes against a plain k-means over every part."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waterloom.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * c)) for c in v], lab) for i, v, lab in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    width = len(kept[0][1]) // parts
    seeds = {}
    for i, q, _ in kept:
        seeds[i] = min(seeds.get(i, q), q)
    order = sorted(seeds, key=lambda i: (i is None, i))[:entries]
    cut = lambda q: [q[p * width:(p + 1) * width] for p in range(parts)]
    book = [[cut(seeds[i])[p] for i in order] for p in range(parts)]

    def assign():
        out = []
        for _, q, _ in kept:
            pairs = [min((sum((a - b) ** 2 for a, b in zip(x, e)), k)
                         for k, e in enumerate(book[p])) for p, x in enumerate(cut(q))]
            out.append(([k for _, k in pairs], sum(d for d, _ in pairs)))
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(order)):
                own = [cut(kept[n][1])[p] for n, (c, _) in enumerate(got) if c[p] == k]
                if own:
                    book[p][k] = [sum(col) // len(own) for col in zip(*own)]
    got = assign()
    label = {}
    for (_, _, lab), (_, e) in zip(kept, got):
        label[lab] = label.get(lab, 0) + e
    text = ",".join(str(c) for p in book for e in p for c in e)
    return sorted((repr(i), "".join(f"{k:02x}" for k in c), e, label[lab])
                  for (i, _, lab), (c, e) in zip(kept, got)), hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("code", "q", "n", "_1"):  # names that the operator uses itself
        df = df.withColumn(name, F.lit("x"))
    coded, book = codes.compress(df, **more)
    out = codes.with_label_errors(coded).withColumn("code", codes.hex_code("code")).collect()
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in out), codes.digest(book)


def table(n, width=2, parts=16, seed=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 3, (9, parts * width))
    return [(int(i), (centres[i % 9] + rnd.normal(0, 0.3, parts * width)).tolist(), int(i % 4))
            for i in rnd.permutation(n)]


def test_equals_a_plain_search_with_odd_rows(spark):
    rows = table(300)
    bad = [(900, None, 1), (901, [], 1), (902, [None] * 32, 2), (903, [float("nan")] * 32, 2),
           (904, [float("-inf")] * 32, 0)]
    odd = [(None, rows[5][1], None), (7, rows[8][1], None), (500, [0.0] * 32, None),
           (501, [-0.001] * 32, 3), rows[3], rows[3], (11, rows[2][1], 1)]
    assert run(spark, rows + bad + odd) == plain(rows + bad + odd)


def test_few_ids_ties_and_large_numbers(spark):
    rows = [(3, [1.0] * 16, None), (1, [2.0] * 16, 1), (1, [2.0] * 16, 1), (2, [1.5] * 16, 1)]
    assert run(spark, rows) == plain(rows)
    big = [(i, [float(10 ** 5 * (i % 5)) + i] * 16, 1) for i in range(20)]
    assert run(spark, big, entries=3) == plain(big, entries=3)


def test_lengths_that_do_not_fit_go(spark):
    rows = table(40)
    more = [(600, [1.0] * 16, 0), (601, [1.0] * 33, 0)]
    assert run(spark, rows + more) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [], None)]])
def test_nothing_to_code(spark, rows):
    assert run(spark, rows)[0] == []


def test_bounds_spare_scans_and_never_change_a_code():
    rnd = np.random.default_rng(4)
    x = rnd.integers(-2000, 2000, (500, 4, 3))
    book = x[:32].transpose(1, 0, 2).copy()
    history, state = [book], (np.zeros((500, 4), np.uint8), np.zeros((500, 4), np.float32),
                              np.zeros((500, 4), np.uint8))
    counts = []
    for _ in range(6):
        error, scanned = codes.assign(x, *state, history)
        counts.append(scanned)
        d = ((x[:, :, None, :] - history[-1][None]) ** 2).sum(axis=3)
        assert (state[0] == d.argmin(axis=2)).all() and (error == d.min(axis=2)).all()
        following = history[-1].copy()
        for p in range(4):
            for k in range(32):
                if (own := x[state[0][:, p] == k, p]).size:
                    following[p, k] = np.floor(own.sum(axis=0) / len(own))
        history.append(following)
    assert counts[0] == 2000 and counts[-1] < 1000
    # the bound is by the way an entry has really gone: there and back is no way at all
    assert (codes.moved(book[0], book[0], state[0][:, 0]) == 0).all()
