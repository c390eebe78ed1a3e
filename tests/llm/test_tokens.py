"""Token ids, counts, packing and shards against the tokenizer library itself."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waterloom.llm import packing, shards, tokens

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", " ", "\t\n", "Plain text, with 12 numbers & signs!!", "I've it's 'll x'S don't",
    "<|startoftext|>a b<|endoftext|>", "<|startof text|>", "İstanbul ΣΑΣ",
    "a\x1cb\x85c\x00d", "日本語 中文", "éa  x é", "²³½",
    "\U0001f600\U0001f600 hi", "x" * 5000, "naïve – … “q”", "﻿abc",
    "word " * 9000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokens.default_vocabulary())


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_and_heap_counts_are_the_library_s(library):
    path = tokens.default_vocabulary()
    ids = list(tokens.WordIds(path).encode(TEXTS))
    counts = list(tokens.MergeCounts(path).count(TEXTS))
    for text, got, n in zip(TEXTS, ids, counts):
        want = expected(library, text)
        assert got == np.array(want, "<u4").tobytes(), text
        assert n == len(want), text


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 3)
    coder = tokens.WordIds(tokens.default_vocabulary())
    for _ in range(2):
        assert [len(x) // 4 for x in coder.encode(TEXTS)] == [
            len(expected(library, t)) for t in TEXTS]


def test_token_count_column(spark, library):
    df = spark.createDataFrame(enumerate(TEXTS), "doc_id long, text string")
    got = df.select("doc_id", tokens.token_count("text").alias("n")).collect()
    assert {r[0]: r[1] for r in got} == {i: len(expected(library, t)) for i, t in enumerate(TEXTS)}


def test_fill_uses_every_piece_once_and_closest():
    rnd = random.Random(3)
    for _ in range(30):
        capacity = rnd.choice((8, 64, 300))
        counts = collections.Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(0, 200)))
        runs = packing.fill(dict(counts), capacity)
        used = collections.Counter()
        for times, parts in runs:
            assert times > 0 and sum(n * m for n, m in parts) <= capacity
            used.update({n: m * times for n, m in parts})
        assert used == counts
    # the remaining lengths that come closest to the capacity, not the largest that fit
    assert packing.fill({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [(6, 1), (2, 2)])


def test_packed_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[4]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("x"))
    got = packing.packed(df.repartition(3), capacity=512).collect()
    per = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in got:
        per[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert sorted(windows) == list(range(len(windows)))
    for i, t in enumerate(TEXTS):
        ids = np.array(expected(library, t) + [2], "<u4")
        copies = 2 if i == 3 else 1
        if copies == 2:
            continue
        at = 0
        for r in sorted(per[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in per[None]) == len(expected(library, "no id")) + 1
    assert packing.packed(df.limit(0)).count() == 0


def test_sequences_hold_the_ids(spark, library):
    df = spark.createDataFrame([(1, "some text here"), (2, "more of it")], "doc_id long, text string")
    packs = packing.packed(df, capacity=64, keep_ids=True)
    rows = packing.sequences(packs).collect()
    got = sorted(np.frombuffer(b"".join(r.ids for r in rows), "<u4").tolist())
    assert got == sorted(expected(library, "some text here") + expected(library, "more of it") + [2, 2])


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation_is_a_bijection(n):
    for key in (1, 2):
        slots = shards.permute(np.arange(n), n, key)
        assert sorted(slots.tolist()) == list(range(n))
    if n == 1000:
        assert (shards.permute(np.arange(n), n, 1) != shards.permute(np.arange(n), n, 2)).any()


def test_shards_read_back_in_slot_order(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit(0))
    cut = shards.materialize(shards.cut(df.repartition(2), length=16))
    index = shards.write_shards(cut, length=16, slots=100)
    listed = index.orderBy("slot").collect()
    assert [r.slot for r in listed] == list(range(len(listed)))
    assert all(r.shard == r.slot // 100 and r.offset == r.slot % 100 * 32 for r in listed)
    read = list(shards.read_slots(index.shard_root, 0, len(listed), length=16, slots=100))
    assert [zlib.crc32(x.tobytes()) for x in read] == [r.ids_crc32 for r in listed]
    later = list(shards.read_slots(index.shard_root, 150, 7, length=16, slots=100))
    assert all((a == b).all() for a, b in zip(later, read[150:]))
    total = sum(len(expected(library, t)) + 1 for t in TEXTS)
    assert sum(r.n_tokens for r in listed) == total
    assert {i for r in listed for i in r.doc_ids} == set(range(len(TEXTS)))
    assert shards.token_shards(df.limit(0)).count() == 0
