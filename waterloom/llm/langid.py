"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into ``BUCKETS`` features.  Document frequencies are
counted over every document one may learn from; the weights are fitted on a sample of at most
``SAMPLE`` labelled documents by follow-the-regularised-leader with elastic-net penalties (which
leaves most weights exactly zero), and a temperature fitted on sample documents that the weights
have not seen turns scores into calibrated probabilities.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterloom.llm.common import bound_batches, groups

BUCKETS = 1 << 16
ORDERS = 3
#: Bound of the labelled sample the weights and the temperature are fitted on.
SAMPLE = 4000
#: Passes of the leader over the sample, its learning rate and its penalties.
PASSES, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.002, 0.002
UNKNOWN = "und"
#: Characters whose n-grams are held together; a longer text is taken in pieces of this many,
#: whose n-grams add up (those across a cut are left out).
SPAN = 1 << 18


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter, for the first 65,536 and one entry for all others."""
    flags = np.fromiter(
        (unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)), bool, 0x10000)
    return np.append(flags, True)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] == "L" for c in set(text))


def gram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every n-gram of every text, all orders, and where each text's begin.

    A text is lower-cased and every run of other characters than letters becomes one blank.
    """
    table, parts, sizes = letters(), [np.zeros(0, np.int64)], []
    for t in texts:
        p = code_points((t or "").lower())
        p = np.concatenate([[32], np.where(table[np.minimum(p, 0x10000)], p, 32), [32]])
        parts.append(p[np.append(True, (p[1:] != 32) | (p[:-1] != 32))])
        sizes.append(len(parts[-1]))
    p = np.concatenate(parts).astype(np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(p))  # characters to the text's end
    h, all_ids = p.copy(), []
    for order in range(ORDERS):
        if order:
            after = np.zeros(len(p), np.uint64)
            after[:-order] = p[order:]
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(left > order, after, np.uint64(0))
        mixed = (h + np.uint64(order + 1)) * np.uint64(0xD6E8FEB86659FD93)
        all_ids.append((mixed >> np.uint64(48)).astype(np.int64) % BUCKETS)
    ids = np.stack(all_ids, axis=1).reshape(-1) if sizes else np.zeros(0, np.int64)
    starts = ORDERS * np.cumsum([0, *sizes])
    return ids, starts


def pieces(text: str | None) -> list[str]:
    """The text, or consecutive pieces of at most ``SPAN`` characters that make it up."""
    text = text or ""
    return [text[i:i + SPAN] for i in range(0, max(len(text), 1), SPAN)]


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``bucket`` and the number of documents that have it; bucket -1 counts all documents."""

    bound_batches(docs.sparkSession)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for frame in parts:
            for t in frame["text"]:
                seen = np.zeros(BUCKETS, bool)
                for piece in pieces(t):
                    seen[gram_ids([piece])[0]] = True
                total += seen
                n += 1
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(used, -1), "docs": np.append(total[used], n)})

    rows = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInPandas(count, "bucket int, docs bigint").groupBy("bucket").agg(
        F.sum("docs").alias("docs"))


def sample(docs: DataFrame, *, doc_id: str, text: str, lang: str, size: int) -> DataFrame:
    """At most about ``size`` labelled rows, the same share of every language or all it has.

    Rows are chosen by a hash of id and text, so the choice does not depend on their order.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
        F.xxhash64(F.lit("sample"), F.col(doc_id).cast("string"), F.col(text)).alias("draw"))
    # a sample holds no more languages than rows; the most frequent come first
    per = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(size).collect()
    if not per:
        return rows.limit(0)
    share = size / len(per)
    parts = F.create_map(*[F.lit(x) for r in per for x in (r[0], min(1.0, share / r[1]))])
    rank = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    return rows.where(rank < F.coalesce(parts[F.col("lang")], F.lit(0.0)))


def _rows(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        counts = sum(np.bincount(gram_ids([p])[0], minlength=BUCKETS) for p in pieces(t))
        used = np.flatnonzero(counts)
        out.append((used, counts[used] / counts.sum() * idf[used]))
    return out


def fit_weights(rows, y: np.ndarray, classes: int) -> np.ndarray:
    """Follow the regularised leader, one document at a time, with elastic-net penalties."""
    z = np.zeros((BUCKETS, classes))
    n = np.zeros((BUCKETS, classes))
    target = np.eye(classes)

    def weights(zz, nn):
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(nn)) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            used, x = rows[i]
            w = weights(z[used], n[used])
            s = x @ w
            p = np.exp(s - s.max())
            g = np.outer(x, p / p.sum() - target[y[i]])
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / ALPHA
            z[used] += g - sigma * w
            n[used] += g * g
    return weights(z, n)


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss on documents the weights have not seen."""
    if not len(y):
        return 1.0
    best, least = 1.0, np.inf
    for t in np.geomspace(0.02, 5.0, 60):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        loss = np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y])
        if loss < least:
            best, least = float(t), loss
    return best


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        size: int = SAMPLE) -> dict:
    """Learn from ``docs``: every document counts for the frequencies, a sample for the weights.

    Rows without language or text teach nothing.  Without any labelled row nothing is learned and
    every prediction is unknown.
    """
    df = {r[0]: r[1] for r in document_frequencies(docs, text).collect()}  # BUCKETS rows at most
    total = df.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(1.0 + total))
    for b, c in df.items():
        idf[b] = np.log((1.0 + total) / (1.0 + c)) + 0.1

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["draw", "lang", "text"])
        langs = sorted(frame["lang"].unique())
        index = {v: i for i, v in enumerate(langs)}
        y = frame["lang"].map(index).to_numpy()
        rows = _rows(frame["text"].tolist(), idf)
        aside = np.arange(len(rows)) % 5 == 4
        w = fit_weights([r for r, a in zip(rows, aside) if not a], y[~aside], len(langs))
        held = [r for r, a in zip(rows, aside) if a]
        scores = np.array([x @ w[u] for u, x in held]).reshape(len(held), len(langs))
        t = fit_temperature(scores, y[aside])
        return pd.DataFrame({"langs": [langs], "weights": [(w / t).astype("<f4").tobytes()]})

    chosen = sample(docs, doc_id=doc_id, text=text, lang=lang, size=size)
    found = chosen.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        train, "langs array<string>, weights binary").first()
    if found is None:
        return {"langs": [], "table": np.zeros((BUCKETS, 1), np.float32)}
    w = np.frombuffer(found["weights"], "<f4").reshape(BUCKETS, -1)
    return {"langs": list(found["langs"]), "table": (w * idf[:, None]).astype(np.float32)}


def score_texts(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    langs, out, score = model["langs"], [], np.zeros(len(texts))
    for a, b in groups(texts, SPAN):
        part = texts[a:b]
        sums, sizes = 0.0, 0
        for piece in ([p] for p in pieces(part[0])) if len(part) == 1 else (part,):
            ids, starts = gram_ids(piece)
            sums = sums + np.add.reduceat(model["table"].take(ids, axis=0), starts[:-1], axis=0)
            sizes = sizes + np.diff(starts)
        s = np.asarray(sums, np.float64) / np.maximum(1, sizes)[:, None]
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for i, t in enumerate(part):
            known = bool(langs) and has_letter(t)
            out.append(langs[best[i]] if known else UNKNOWN)
            score[a + i] = p[i, best[i]] if known else 0.0
    return out, score


def predict(spark, model: dict, text: Column | str) -> Column:
    """Struct of ``lang_pred`` and ``score`` (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0; ties take the first language
    in alphabetical order.  Only the text is read.
    """
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS rows by the languages of the sample

    @F.pandas_udf("lang_pred string, score double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lang, score = score_texts(shared.value, part.tolist())
            yield pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": score})

    return of(text)
