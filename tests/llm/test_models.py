"""Learned operators: held-out accuracy, defined cases, and the parts that can be checked exactly."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waterloom.llm import langid, lm, quality

SYLLABLES = {"aa": ["the", "ing", "er", "and", "st"], "bb": ["que", "ción", "lla", "ñ", "os"]}


def text_of(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(n))


def language_rows(n=240):
    rnd = random.Random(1)
    return [(i, text_of(rnd, lang := rnd.choice(["aa", "bb"]), rnd.randint(3, 60)), lang)
            for i in range(n)]


def test_language_of_held_out_texts(spark):
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 != 1"))
    odd = spark.createDataFrame([(900, None, "aa"), (901, "", None), (902, "12 !!", "bb"),
                                 (903, "ñ", None)], df.schema)
    out = df.unionByName(odd).withColumn("score", F.lit("mine")).select(
        "doc_id", "lang", langid.predict(spark, model, "text").alias("p")).collect()
    held = [r for r in out if r.doc_id % 3 == 1 and r.doc_id < 900]
    assert sum(r.p.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r.p for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "bb"
    assert all(0 <= r.p.score <= 1 for r in out)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert df.select(langid.predict(spark, model, "text").alias("p")).first().p.lang_pred == "und"


def test_document_frequencies_count_documents(spark):
    texts = ["ab ab", "ab", "", None, "zz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r[0]: r[1] for r in langid.document_frequencies(df).collect()}
    want = collections.Counter()
    for t in texts:
        if t is not None:
            want.update(set(langid.gram_ids([t])[0].tolist()))
    assert got.pop(-1) == 4
    assert got == dict(want)


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["One two", "", "x", "Été 12 ñandú", "One two"]
    ids, starts = langid.gram_ids(texts)
    for i, t in enumerate(texts):
        assert (ids[starts[i]:starts[i + 1]] == langid.gram_ids([t])[0]).all()


def quality_rows(n=300):
    rnd = random.Random(2)
    out = []
    for i in range(n):
        words = text_of(rnd, "aa", rnd.randint(5, 80)).split()
        good = rnd.random() < 0.8
        if not good:
            words = [w + rnd.choice(["$$$", "%%%"]) for w in words]
        out.append((i, " ".join(words), int(good)))
    return out


def test_quality_of_held_out_texts(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, quality int")
    labels = labels.unionByName(spark.createDataFrame([(3, None)], labels.schema))
    model = quality.fit(docs, labels)
    out = {r[0]: r[1] for r in docs.select(
        "doc_id", quality.score(spark, model, "text").alias("s")).collect()}
    held = [(out[i], y) for i, _, y in rows if i % 5 == 0]
    assert sum((s >= 0.5) == (y == 1) for s, y in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(None,), ("",), ("x",), ("ab " * 200_000,)], "text string")
    assert all(0 <= r.s <= 1 for r in odd.select(quality.score(spark, model, "text").alias("s")).collect())


def test_every_place_of_a_text_reaches_the_pool():
    draw = np.random.default_rng(5)
    filters = draw.normal(size=(quality.WIDTH, 257, quality.FILTERS)).astype(np.float32)
    for n in (0, 1, 5, 127, 128, 129, 1000):
        x = quality._bytes("".join(chr(c) for c in draw.integers(32, 127, n)))
        halves = quality._halves(x, filters)
        plain = np.array([sum(filters[j][x[i + j]] for j in range(quality.WIDTH))
                          for i in range(len(x) - quality.WIDTH + 1)])
        assert np.allclose(halves.max(axis=0), plain.max(axis=0), atol=1e-5)


def test_scores_do_not_depend_on_the_group(monkeypatch):
    rows = quality_rows(60)
    model = quality.fit_arrays([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    texts = [t for _, t, _ in rows] + [None, "", "long " * 5000]
    together = quality.score_texts(model, texts)
    alone = np.array([quality.score_texts(model, [t])[0] for t in texts])
    assert np.allclose(together, alone)
    monkeypatch.setattr(quality, "SPAN", 1024)
    assert np.allclose(together, quality.score_texts(model, texts))


def test_language_model_scores(spark):
    rnd = random.Random(3)
    rows = [(i, text_of(rnd, "aa", rnd.randint(0, 60)).title()) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "zzqx zzqx zzqx"), (None, "the ing"), (5, "the ing")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1))
    train = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))
    model = lm.fit(df, train)
    got = lm.score(df, model, held_out=~train).collect()
    assert len(got) == len(rows)
    counts = collections.Counter()
    for i, t in rows:
        if i is None or i % 7 != 2:
            counts.update(lm.tokens(t) + [b""])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in rows:
        w = lm.tokens(t) + [b""]
        want[i, len(w), sum(counts[x] > 0 for x in w),
             round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert collections.Counter(
        (r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert all(r.held_out == (r.doc_id is not None and r.doc_id % 7 == 2) for r in got)
    # the same without the words that tasks hold: all counts are joined
    held = lm.HELD_WORDS
    try:
        lm.HELD_WORDS = 2
        joined = lm.score(df, model, held_out=~train).collect()
    finally:
        lm.HELD_WORDS = held
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_bytes)
    for a, b in zip(sorted(got, key=key), sorted(joined, key=key)):
        assert abs(a.score - b.score) < 1e-6 * abs(a.score)


def test_contexts_count_every_occurrence(spark):
    words = {b"the": 5, b"then": 1, b"thing": 40, b"": 12, "gr\u00fcn".encode(): 3_000_000_000}
    df = spark.createDataFrame([(bytearray(w), c) for w, c in words.items()],
                               "word binary, c long").repartition(3)
    want = np.zeros((len(lm.CONTEXTS), 2 * lm.SLOTS), np.int64)
    for w, c in words.items():
        for k in range(8):
            bit, slots = lm.Bits([w]).bit(k)
            for i, s in enumerate(slots):
                for at in 2 * s + bit:
                    want[i, at] += c
    got = np.zeros_like(want)
    for r in lm.context_counts(df).collect():
        got[r.context, 2 * lm.BLOCK * r.block:2 * lm.BLOCK * (r.block + 1)] = np.frombuffer(
            r.counts, np.uint8)
    assert (got == lm.levels(want)).all() and got.max() > 250


def test_spellings_are_probabilities():
    words = [b"the", b"then", b"thing", b"", b"a"]
    table = np.zeros((len(lm.CONTEXTS), lm.SLOTS, 2), np.uint8)
    mixer = lm.Mixer(table)
    for _ in range(20):
        mixer.learn(words)
    # all continuations of one byte sum to one
    firsts = [bytes([b]) for b in range(256) if b != lm.END]
    total = 0.0
    for b in range(256):
        bits = lm.Bits([bytes([b])]) if b != lm.END else lm.Bits([b""])
        p = 1.0
        refined = mixer.apm[0] / mixer.apm[1]
        for k in range(8):
            bit, x, ga, gb = mixer._inputs(bits, k, own=0)
            dot = mixer._mix(x, ga, gb)
            q = 0.5 / (1 + np.exp(-dot)) + 0.5 * refined[bits.before, mixer._step(dot)]
            p *= (q if bit[0] else 1 - q)[0]
        total += p
    assert abs(total - 1) < 1e-6
    assert len(mixer.log10(firsts)) == len(firsts)
    assert (mixer.log10(words) < 0).all()


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, lm.fit(df, F.lit(True))).count() == 0
    one = spark.createDataFrame([(1, "abc")], df.schema)
    row = lm.score(one, lm.fit(one, F.lit(False))).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.score < 0


def test_held_gains_are_those_computed_anew():
    for p, times in ((-3.25, 2), (-0.5, 7), (-3.25, 2), (-11.0, 400)):
        assert lm.adapted_gains(p, times) == tuple(lm.adapted(p, times, a) for a in lm.STRENGTHS)
    assert lm.adapted_gains.cache_info().maxsize and lm.text_gains.cache_info().maxsize
    assert lm.text_gains(1) == pytest.approx([0.0] * len(lm.STRENGTHS), abs=1e-9)
