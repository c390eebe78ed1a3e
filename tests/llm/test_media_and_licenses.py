"""Media shards by exact round trip, license scans against brute force."""

import collections
import hashlib
import io
import random
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from waterloom.llm import licenses, media
from waterloom.llm.common import open_store


def payload(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * media.SLICE + 5])
def test_image_round_trip(n):
    p = media.payload_of("x" * n)
    image = media.encode_image(p)
    assert media.decode_image(image) == p == payload("x" * n)
    assert media.image_header(image[:media.HEADER_BYTES]) == ("image/png", 576, len(p) // 576, 8)
    with pytest.raises(ValueError):
        media.decode_image(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def test_stored_payloads(spark, tmp_path):
    texts = [None, "", "short", "é" * 700, "short", "y" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "short"), (2, "short")],
                               "doc_id long, text string").withColumn("offset", F.lit("mine"))
    index = media.store(df.repartition(2), folder=str(tmp_path / "m"), shard_bytes=600)
    rows = index.collect()
    assert len(rows) == len(texts) + 2
    system, base = open_store(index.media_root)
    # a payload is once in a shard, under the digest of its bytes, and tar readers agree
    for shard in {r.shard for r in rows}:
        with system.open_input_file(f"{base}/{shard}") as f:
            data = f.read()
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            names = tar.getnames()
            assert len(names) == len(set(names))
            for name in names:
                body = tar.extractfile(name).read()
                assert name.split("/")[1] == hashlib.sha256(body).hexdigest() + ".png"
    heads = media.headers(index, index.media_root).collect()
    assert all(r.kind == "image/png" and r.width == 576 and r.bits == 8 for r in heads)
    back = {(r.doc_id, r.n_bytes): r for r in media.read_back(index, index.media_root).collect()}
    for i, t in enumerate(texts):
        p, r = payload(t), back[i, len((t or "").encode())]
        assert (r.payload_bytes, r.payload_sha256) == (len(p), hashlib.sha256(p).hexdigest())
        assert r.tail_crc32 == zlib.crc32(p[-32:]) and len(r.feature) == 16
    assert back[2, 5].media_sha256 == back[None, 5].media_sha256
    assert media.store(df.limit(0)).count() == 0


def brute(words, shingles, k, m):
    """Whether some region of three template lengths holds enough of the shingles."""
    best = 0.0
    for at in range(max(1, len(words) - k + 1)):
        have = {tuple(words[i:i + k]) for i in range(at, min(len(words) - k + 1, at + m))}
        best = max(best, len(have & shingles) / len(shingles))
    return best


def test_scan_finds_what_brute_force_finds(spark):
    rnd = random.Random(6)
    long_ = " ".join(f"clause{i} of{rnd.randint(0, 9)}" for i in range(90))
    templates = [*licenses.TEMPLATES, ("own", long_), ("tiny", "All rights"), ("none", "!!")]
    docs, planted = [], {}
    for i in range(120):
        w = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(0, 150))]
        name, text = rnd.choice(templates[:-1])
        body = text.split()
        edits = rnd.choice((0, 0, 1, 3))
        for _ in range(edits):
            body[rnd.randrange(len(body))] = "changed"
        at = rnd.randint(0, len(w))
        docs.append((i, " ".join(w[:at] + body + w[at:])))
        planted[i] = name
    docs += [(500, None), (501, ""), (502, long_.upper() + " x " + long_), (None, "all RIGHTS")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("matches", F.lit(0))
    got = {r.doc_id: r.matches for r in licenses.scan(df, templates).collect()}
    s = licenses.Scanner(templates)
    for i, text in docs[:120]:
        words = licenses.words_of(text)
        names = {m.template for m in got[i]}
        for name, sset, k, w in zip(s.names, s.sets, s.width, s.words):
            if brute(words, sset, k, len(w) - k + 1) >= licenses.CONTAINMENT:
                assert name in names, (i, name)
        for m in got[i]:
            o = s.names.index(m.template)
            k = s.width[o]
            have = {tuple(words[j:j + k]) for j in range(m.start, m.end - k + 1)}
            assert len(have & s.sets[o]) / len(s.sets[o]) >= licenses.CONTAINMENT
    assert got[500] == got[501] == []
    assert [m.template for m in got[502]].count("own") == 2
    assert [m.template for m in got[None]] == ["tiny"]
    assert licenses.scan(df, []).where(F.size("matches") > 0).count() == 0
    assert licenses.scan(df.limit(0), templates).count() == 0


def test_short_texts_and_slices(monkeypatch):
    notice = dict(licenses.TEMPLATES)["gpl-3.0-notice"]
    cut = " ".join(notice.split()[1:])  # seven of eight shingles, shorter than the window
    long_ = "w " * 3000 + notice + " w" * 3000
    texts = [cut, "", None, cut, "x " * 50, long_]
    s = licenses.Scanner(list(licenses.TEMPLATES))
    alone = [s.scan([t])[0] for t in texts]
    assert [[m[0] for m in found] for found in alone] == [
        ["gpl-3.0-notice"], [], [], ["gpl-3.0-notice"], [], ["gpl-3.0-notice"]]
    assert s.scan(texts) == alone
    monkeypatch.setattr(licenses, "SLICE_WORDS", 64)
    assert s.scan(texts) == alone


def test_several_runs_of_templates_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(t for _, t in licenses.TEMPLATES))],
                                 "doc_id long, text string")
    whole = licenses.scan(docs).first().matches
    monkeypatch.setattr(licenses, "groups", lambda texts, limit: [(i, i + 1) for i in range(len(texts))])
    assert collections.Counter(licenses.scan(docs).first().matches) == collections.Counter(whole)
    assert {m.template for m in whole} >= {n for n, _ in licenses.TEMPLATES}
