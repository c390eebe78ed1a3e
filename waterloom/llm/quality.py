"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over the whole text.  Their outputs are max-pooled in chunks of
``CHUNK`` places that overlap by half; the largest and the mean pooled value of every filter over
all chunks feed one logistic unit.  The network is fitted on at most ``SAMPLE`` labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterloom.llm.common import bound_batches, groups

WIDTH = 4
FILTERS = 8
CHUNK = 256
HALF = CHUNK // 2
#: Bound of the labelled sample, and how it is learned.
SAMPLE = 2400
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.02, 1e-4
SEED = 11
THRESHOLD = 0.3
#: Texts convolved together, in bytes; a longer text is taken in pieces of this size.
SPAN = 1 << 17
PAD = 256


def _bytes(text: str | None) -> np.ndarray:
    """The text's bytes and one filter width of padding, so that every text has a place."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.full(len(raw) + WIDTH, PAD, np.int16)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def _convolve(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Filter outputs at every place of ``x``; filters: (WIDTH, 257, FILTERS)."""
    n = len(x) - WIDTH + 1
    out = filters[0].take(x[:n], axis=0)
    for j in range(1, WIDTH):
        out += filters[j].take(x[j:j + n], axis=0)
    return out


def _halves(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Maxima over blocks of half a chunk, for one document of any length, in bounded memory."""
    out = []
    for at in range(0, len(x) - WIDTH + 1, SPAN):
        y = _convolve(x[at:at + SPAN + WIDTH - 1], filters)
        out.append(np.maximum.reduceat(y, np.arange(0, len(y), HALF), axis=0))
    return np.concatenate(out)


def _features(halves: np.ndarray) -> np.ndarray:
    """Largest and mean of the overlapping chunks' pooled values, after a rectifier."""
    chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    chunks = np.maximum(chunks, 0)
    return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])


def score_texts(model: dict, texts: list[str | None]) -> np.ndarray:
    filters, w, b = model["filters"], model["w"], model["b"]
    out = np.empty(len(texts))
    for a, z in groups(texts, SPAN):
        part = [_bytes(t) for t in texts[a:z]]
        if len(part) == 1:
            rows = [_features(_halves(part[0], filters))]
        else:
            y = _convolve(np.concatenate([*part, np.full(WIDTH, PAD, np.int16)]), filters)
            rows, at = [], 0
            starts, sizes = [], []
            for p in part:  # the padding keeps a text's last window out of the next text
                n = len(p) - WIDTH + 1
                mine = np.arange(at, at + n, HALF)
                starts += [mine, [at + n]]
                sizes.append(len(mine))
                at += len(p)
            pooled = np.maximum.reduceat(y, np.concatenate(starts).astype(np.int64), axis=0)
            at = 0
            for k in sizes:
                rows.append(_features(pooled[at:at + k]))
                at += k + 1
        s = np.array(rows) @ w + b
        out[a:z] = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    return out


def _train_step(x: np.ndarray, y: float, model: dict, grads: dict) -> None:
    """Add one document's gradients: only the place each pooled value came from takes part."""
    n = len(x) - WIDTH + 1
    conv = _convolve(x, model["filters"])
    blocks = -(-n // HALF)
    padded = np.full((blocks * HALF, FILTERS), -np.inf, np.float32)
    padded[:n] = conv
    padded = padded.reshape(blocks, HALF, FILTERS)
    where = padded.argmax(axis=1) + (np.arange(blocks) * HALF)[:, None]
    halves = padded.max(axis=1)
    if blocks > 1:
        later = halves[1:] > halves[:-1]
        chunks, place = np.maximum(halves[:-1], halves[1:]), np.where(later, where[1:], where[:-1])
    else:
        chunks, place = halves, where
    live = np.maximum(chunks, 0)
    top = live.argmax(axis=0)
    k = len(live)
    f = np.concatenate([live[top, np.arange(FILTERS)], live.mean(axis=0)])
    p = 1 / (1 + np.exp(-np.clip(f @ model["w"] + model["b"], -30, 30)))
    d = p - y
    grads["w"] += d * f
    grads["b"] += d
    down = np.tile(d * model["w"][FILTERS:] / k, (k, 1))
    down[top, np.arange(FILTERS)] += d * model["w"][:FILTERS]
    down *= chunks > 0
    cols = np.broadcast_to(np.arange(FILTERS), place.shape)
    for j in range(WIDTH):
        np.add.at(grads["filters"][j], (x[place + j], cols), down)


def fit_arrays(texts: list[str], labels: np.ndarray) -> dict:
    """Adam over shuffled batches; labels 0 or 1."""
    draw = np.random.default_rng(SEED)
    model = {
        "filters": draw.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32),
        "w": draw.normal(0, 0.3, 2 * FILTERS), "b": np.zeros(1),
    }
    first = {k: np.zeros_like(v, np.float64) for k, v in model.items()}
    second = {k: np.zeros_like(v, np.float64) for k, v in model.items()}
    xs, step = [_bytes(t) for t in texts], 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(xs))
        for at in range(0, len(xs), BATCH):
            grads = {k: np.zeros_like(v, np.float64) for k, v in model.items()}
            rows = order[at:at + BATCH]
            for i in rows:
                # a very long text is learned from one span, another in each pass
                x = xs[i]
                if len(x) > SPAN:
                    begin = int(draw.integers(0, len(x) - SPAN))
                    x = x[begin:begin + SPAN]
                _train_step(x, float(labels[i]), model, grads)
            step += 1
            for k, g in grads.items():
                g = g / len(rows) + DECAY * model[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9 ** step) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                model[k] = (model[k] - RATE * move).astype(model[k].dtype)
    return {**model, "b": float(model["b"][0])}


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str,
           size: int) -> DataFrame:
    """At most about ``size`` labelled rows, as labelled documents come (no class is favoured)."""
    marks = labels.where(F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("label_id"), F.col(label).cast("int").alias("label"))
    total = marks.count()
    rank = F.pmod(F.xxhash64(F.lit("sample"), F.col("label_id").cast("string")), F.lit(1 << 30))
    marks = marks.where(rank / float(1 << 30) < size / max(total, 1))
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("label_id"), F.col(text).alias("text"))
    # the sample of labels is bounded by `size`, whatever the table's size
    return rows.join(F.broadcast(marks.limit(2 * size)), "label_id").select(
        "label_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", size: int = SAMPLE) -> dict:
    """Learn from the labelled documents among ``docs``; null labels and texts teach nothing.

    Without any labelled document every score is one half.
    """

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["label_id", "text"])
        m = fit_arrays(frame["text"].tolist(), frame["label"].to_numpy())
        return pd.DataFrame({"filters": [m["filters"].astype("<f4").tobytes()],
                             "w": [m["w"].tolist()], "b": [m["b"]]})

    rows = sample(docs, labels, doc_id=doc_id, text=text, label=label, size=size)
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        train, "filters binary, w array<double>, b double").first()
    if found is None:
        return {"filters": np.zeros((WIDTH, 257, FILTERS), np.float32),
                "w": np.zeros(2 * FILTERS), "b": 0.0}
    filters = np.frombuffer(found["filters"], "<f4").reshape(WIDTH, 257, FILTERS)
    return {"filters": filters, "w": np.array(found["w"]), "b": found["b"]}


def score(spark, model: dict, text: Column | str) -> Column:
    """Probability of label 1 (double, 0 to 1) of each whole text.

    Null and empty texts have a score too, that of a text of padding.  Only the text is read, so
    equal texts have equal scores.
    """
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand weights

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(score_texts(shared.value, part.tolist()))

    return of(text)
