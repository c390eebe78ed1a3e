"""SimHash groups and benchmark windows against brute force on small fixtures."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from waterloom.llm import simhash, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(sh))


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def same_groups(mine, brute):
    pair = {}
    return all(pair.setdefault(mine[n], brute[n]) == brute[n] for n in mine) and len(
        set(mine.values())) == len(set(brute.values()))


def test_fingerprint_of_edge_texts():
    for text in (None, "", " \t", "One", "two words", "A b C d", "é ÉÀ É", "x " * 70_000):
        want = plain_fingerprint(text)
        got = simhash.fingerprint_of(text)
        assert got % (1 << 64) == want


@pytest.mark.parametrize("distance", [1, 2])
def test_links_connect_what_brute_force_connects(spark, distance):
    rnd = random.Random(distance)
    fps = {0, 1, 3, 7, (1 << 63) | 5}
    centre = rnd.getrandbits(64)
    # one block of bits varies: its buckets are far over the limit of a bucket
    fps |= {centre ^ (rnd.getrandbits(13)) for _ in range(300)}
    for _ in range(100):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(3):
            y = x
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = [tuple(r) for r in simhash.links(df, distance=distance).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= distance for a, b in got)
    brute = [(a, b) for a in signed for b in signed
             if a < b and ((a ^ b) & mask).bit_count() <= distance]
    assert same_groups(groups_of(got, signed), groups_of(brute, signed))


def test_near_duplicates_defined_cases(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (5, base), (5, base), (None, base), (9, None), (10, ""), (11, "other text"),
            (3, base + " w200")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine"))
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert {(1, 1), (5, 1), (None, 1), (9, 9), (10, 9), (11, 11)} <= got
    assert simhash.near_duplicates(df).count() == len(rows)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id in (1, 5, 9, 10, 11)").collect()) == [1, 9, 11]
    twice = df.unionByName(df.where("doc_id = 1"))
    assert simhash.deduplicate(twice).where("doc_id = 1").count() == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def plain_windows(text, items, span=13):
    words = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for key, item in items:
        w = WORD.findall(lower(item or ""))
        n = min(len(w), span)
        wanted = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in wanted:
                hit.update(range(i, i + n))
                found.add(str(key))
    return len(words), len(hit), sorted(found)


def test_contamination_is_what_brute_force_finds(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(6)] + ["é", "Ünï"]  # few words: many ties and repeats

    def some(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate((1, 2, 4, 5, 8, 12, 13, 14, 20, 40, 60))]
    items += [(20, None), (21, ""), (22, items[8][1]), (22, items[9][1])]
    docs = [(i, some(rnd.choice((0, 3, 12, 13, 30, 80)))) for i in range(60)]
    for i, (key, text) in enumerate(items):
        docs.append((100 + i, f"{some(9)}, {text or ''}! {some(7)}".upper()))
    docs += [(500, None), (501, ""), (None, items[9][1]), (100, "unlike " * 30), (7, "the " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit(1))
    got = sorted(map(tuple, winnow.contamination(df, bench).collect()), key=repr)
    want = []
    for key, text in docs:
        n, hit, found = plain_windows(text, items)
        want.append((key, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(),
                     hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=repr)
    kept = winnow.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == sum(not w[-1] for w in want)


def test_long_windows_only(spark):
    rnd = random.Random(8)
    vocab = [f"x{i}" for i in range(40)]

    def some(n):
        return [rnd.choice(vocab) for _ in range(n)]
    items = [(i, some(rnd.randint(13, 50))) for i in range(12)]
    docs = []
    for i in range(80):
        w = some(rnd.randint(20, 200))
        key, item = rnd.choice(items)
        n = rnd.randint(10, len(item))
        a = rnd.randint(0, len(item) - n)
        at = rnd.randint(0, len(w))
        docs.append((i, " ".join(w[:at] + item[a:a + n] + w[at:])))
    items = [(k, " ".join(w)) for k, w in items]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in winnow.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    for key, text in docs:
        n, hit, found = plain_windows(text, items)
        assert got[key] == (n, hit, len(found))


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    row = winnow.contamination(docs, bench).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
    assert winnow.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
