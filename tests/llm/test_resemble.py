"""Near duplicates of the pipeline against brute-force Jaccard."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from waterloom.llm import resemble


def plain_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_groups(texts):
    sets = [plain_set(t) for t in texts]
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
                continue  # sizes alone part them
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                group[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def partition(labels):
    out = {}
    for key, label in labels:
        out.setdefault(label, set()).add(key)
    return sorted(map(sorted, out.values()))


def corpus():
    rnd = random.Random(3)
    texts = []
    for n in (1, 4, 5, 6, 12, 40, 200, 900):
        for _ in range(4):
            w = [f"w{rnd.randrange(4000)}" for _ in range(n)]
            texts.append(" ".join(w))
            for edits in (0, 1, 2, n // 60, n // 45, n // 30, n // 20):
                v = list(w)
                for _ in range(edits):
                    v[rnd.randrange(n)] = f"e{rnd.randrange(10 ** 6)}"
                texts.append(" ".join(v))
    # a chain: each is near the one before, the ends are far apart
    w = [f"c{i}" for i in range(300)]
    for i in range(12):
        texts.append(" ".join(w[10 * i:10 * i + 180]))
    # a crowd of near copies, and a line that many unlike texts share
    w = [f"k{i}" for i in range(120)]
    for i in range(60):
        v = list(w)
        v[2 * i] = f"other{i}"
        texts.append(" ".join(v))
        texts.append(" ".join(w[:20] + [f"u{i}x{j}" for j in range(15)]))
    return texts + [None, "", " \n "]


def test_groups_are_those_of_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = partition((r.doc_id, bytes(r.component)) for r in resemble.near_duplicates(df).collect())
    want = partition(enumerate(plain_groups(texts)))
    assert got == want
    kept = corpus_pipeline.keep_first_copies(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(g[0] for g in want)


def test_near_copies_of_the_small_table_are_dropped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.keep_first_copies(spark, docs, "").collect()}
    ids = sorted(rows)
    want = partition(zip(ids, plain_groups([rows[i] for i in ids])))
    assert kept == {g[0] for g in want}
    assert len(kept & {2, 56}) <= 1 and len(kept & {1, 255}) <= 1


def test_one_id_on_two_texts_and_rows_without_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (3, "alone"), (None, a), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, resemble.deduplicate(df).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (3, "alone"), (None, a)], key=repr)
    assert resemble.deduplicate(df).columns == df.columns
    assert resemble.deduplicate(df.limit(0)).count() == 0


def test_filter_of_hashes_misses_none(spark):
    from pyspark.sql import functions as F

    from waterloom.llm.common import hash_filter, with_filter

    hashes = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"), F.lit(1).alias("_bits"))
    got = with_filter(rows, hash_filter(hashes, "h"), "h", "in")
    assert got.columns == ["id", "h", "_bits", "in"]
    found = {r.id for r in got.where("in").collect()}
    assert set(range(0, 3000, 3)) <= found and len(found) < 1010 and got.count() == 3000
    assert with_filter(rows, hash_filter(hashes.limit(0), "h"), "h", "in").where("in").isEmpty()


def test_fingerprints_link_the_closest_copies_and_the_similarity_confirms_them(spark):
    rnd = random.Random(11)
    texts = []
    for _ in range(12):
        w = [f"w{rnd.randrange(9000)}" for _ in range(1500)]
        v = list(w)
        v[rnd.randrange(1500)] = "edit"
        texts += [" ".join(w), " ".join(v)]
    texts += ["one two three", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = df.select("text", F.xxhash64("text").alias("text_hash"), resemble.sketch("text").alias(
        "s")).select("text", "text_hash", "s.*")
    assert {r.text: r.fp for r in own.collect()} == {
        t: resemble.fingerprint_of(resemble.shingles_of(t)) for t in texts}
    told = resemble.fingerprint_links(own)
    fp = {r.same: r.fp for r in own.collect()}
    pairs = [(bytes(r.a), bytes(r.b)) for r in told.collect()]
    assert len(pairs) >= 6
    assert all(((fp[a] ^ fp[b]) & (1 << 64) - 1).bit_count() <= 2 for a, b in pairs)
    # no band is shared: what is found comes from the fingerprints, and only what is similar
    alone = own.withColumn("bands", F.array().cast("array<bigint>"))
    ids = {bytes(r.same): r.text for r in own.collect()}
    wrong = own.select(F.min("same").alias("a"), F.max("same").alias("b"))
    told = told.unionByName(wrong).distinct()
    found = {(bytes(r.a), bytes(r.b)) for r in resemble.links(
        resemble._sets(df, alone, "text", told), told).collect()}
    assert found >= set(pairs)
    for a, b in found:
        a, b = plain_set(ids[a]), plain_set(ids[b])
        assert 5 * len(a & b) >= 4 * len(a | b)
