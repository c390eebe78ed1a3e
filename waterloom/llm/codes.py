"""Product codes of vectors: codebooks of vector parts, refined in rounds, and each vector's codes.

Every vector is cut into equal parts and every part position has a codebook of its own.  A round
assigns each part to the nearest entry of its codebook and moves the entries to the means of what
they were given.  Most assignments do not change from one round to the next, so each part carries
its entry, a lower bound on its distance to all other entries, and the round in which that bound
was measured.  All codebooks since the first are kept: what a bound has to give up by now is the
distance the entries have really moved from that round to this one (the norm of the summed
displacements, never more than the summed norms).  Only parts whose bound no longer decides are
held against the whole codebook again.  Distances are whole numbers and compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterloom.llm.common import bound_batches
from waterloom.session import discard, materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Whole steps of a component's unit.
STEPS = 256
#: Double arithmetic is exact below this; larger values are compared as Python integers.
EXACT = 1 << 52
#: What rounding may take from or add to a square root.
SLACK = 1e-12

STATE = ("vec_id {id}, label {label}, q array<bigint>, code binary, low binary, stamp binary, "
         "error bigint, part int, entry int, n bigint, total array<bigint>")


def usable(vector: str) -> Column:
    """Whether a vector is there, and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
        F.lit(False))), F.lit(False))


def steps(vector: str) -> Column:
    """Components in whole steps, rounded down."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(STEPS)) * x.cast("double")))


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lowest of equals), its squared distance, and the next squared distance."""
    if x.dtype == object:
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    else:
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None]
    rows = np.arange(len(x))
    best = d.argmin(axis=1)
    least = d[rows, best].copy()
    d[rows, best] = np.inf
    return best, least, d.min(axis=1)


def moved(then: np.ndarray, now: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Farthest that any entry but the one in ``code`` has moved from ``then`` to ``now``."""
    way = np.sqrt(((now - then) ** 2).sum(axis=1)) * (1 + SLACK)
    if len(way) < 2:
        return np.zeros(len(code))
    order = np.argsort(way)
    return np.where(code == order[-1], way[order[-2]], way[order[-1]])


def assign(x, code, low, stamp, history) -> tuple[np.ndarray, int]:
    """Assign the parts ``x`` (rows, parts, width) to the last codebooks of ``history``.

    ``code``, ``low`` and ``stamp`` (rows, parts) hold the entry, the lower bound on the distance to
    every other entry and the round of that bound; they are brought up to date in place.  Returns
    the squared distances and the number of parts that were held against a whole codebook.
    """
    now, scanned = len(history) - 1, 0
    far = max([0, *(int(abs(b).max()) for b in (x, *history) if b.size)])
    plain = 4 * x.shape[2] * far * far >= EXACT
    cast = (lambda a: a.astype(object)) if plain else (lambda a: a.astype(np.float64))
    out = np.zeros(code.shape, object if plain else np.float64)
    for p in range(x.shape[1]):
        part, book = cast(x[:, p]), cast(history[now][p])
        again = np.ones(len(part), bool)
        if now and not plain:
            d = ((part - book[code[:, p]]) ** 2).sum(axis=1)
            bound = low[:, p].astype(np.float64)
            for t in np.unique(stamp[:, p]):
                rows = stamp[:, p] == t
                bound[rows] -= moved(history[t][p].astype(np.float64), book, code[rows, p])
            again = ~(np.sqrt(d) * (1 + SLACK) < bound * (1 - SLACK))
            out[:, p] = d
        if again.any():
            best, least, following = scan(part[again], book)
            code[again, p], stamp[again, p] = best, now
            out[again, p] = least
            root = np.sqrt(following.astype(np.float64)) * (1 - SLACK)
            low[again, p] = np.nextafter(root.astype(np.float32), np.float32(0))
            scanned += int(again.sum())
    return out, scanned


def _numbers(column, kind, n: int, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, parts).copy()


def _tables(column, width: int, n: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(n, width).astype(np.int64)


def _round(df: DataFrame, history: list[np.ndarray], schema: str) -> DataFrame:
    """One assignment of all vectors; each task adds the sums of what it gave to every entry."""
    now = len(history) - 1
    parts, entries, width = history[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        names = None
        for b in batches:
            n = b.num_rows
            names = names or b.schema
            if not n:
                continue
            x = _tables(b.column("q"), parts * width, n).reshape(n, parts, width)
            if now:
                code, low, stamp = (_numbers(b.column(c), k, n, parts) for c, k in (
                    ("code", np.uint8), ("low", np.float32), ("stamp", np.uint8)))
            else:
                code, stamp = np.zeros((2, n, parts), np.uint8)
                low = np.zeros((n, parts), np.float32)
            error = assign(x, code, low, stamp, history)[0]
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], x[:, p])
            top = (1 << 63) - 1
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id"), "label": b.column("label"), "q": b.column("q"),
                **{k: pa.array([r.tobytes() for r in v], pa.binary())
                   for k, v in (("code", code), ("low", low), ("stamp", stamp))},
                "error": pa.array([min(int(e), top) for e in error.sum(axis=1)], pa.int64()),
                **{k: pa.nulls(n, t) for k, t in SUMS}})
        if names is not None:
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({
                **{k: pa.nulls(len(p), names.field(k).type) for k in ("vec_id", "label", "q")},
                **{k: pa.nulls(len(p), pa.binary()) for k in ("code", "low", "stamp")},
                "error": pa.nulls(len(p), pa.int64()), "part": pa.array(p, pa.int32()),
                "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e], pa.int64()),
                "total": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))})

    return df.mapInArrow(run, schema)


SUMS = (("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
        ("total", pa.list_(pa.int64())))


def _means(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """Entries moved to the mean of their parts, rounded down; what was given nothing stays.

    At most one row per entry of each part comes to the driver."""
    width = book.shape[2]
    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
    out = book.copy()
    for r in state.where("part IS NOT NULL").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *sums).collect():
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the final codebooks as an array (part, entry, position).

    The frame has vec_id, label, code (binary, one byte per part) and error (squared distance to
    the chosen entries, in whole steps).  Rows whose vector is null, empty, has null or non-finite
    components, has another length than the vector of the smallest id, or a length that the parts
    do not divide are left out.  The first codebooks are the vectors of the smallest different
    ids, null counting as the largest id, and of rows that share an id the smallest vector; with
    fewer ids than entries the codebooks are smaller.  Equally near entries: the lowest index.
    Repeated rows stay repeated and count each time.  Only the three named columns are read, so
    others may have any name.  An empty table gives no rows and empty codebooks.  An error beyond
    a long is the largest long.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit a byte")
    bound_batches(vectors.sparkSession)
    rows = vectors.where(usable(vector)).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), steps(vector).alias("q"))
    rows = rows.where((F.size("q") > 0) & (F.size("q") % parts == 0))
    last = F.col("vec_id").isNull()
    first = rows.agg(F.min(F.struct(last.alias("none"), "vec_id", "q")).alias("f")).first()["f"]
    size = len(first["q"]) if first else parts
    rows = rows.where(F.size("q") == size)
    ids = rows.select("vec_id", last.alias("none")).distinct().orderBy("none", "vec_id").limit(
        entries).collect()
    known = [r["vec_id"] for r in ids if not r["none"]]
    early = F.col("vec_id") <= F.lit(known[-1]) if known else F.lit(False)
    if len(known) < len(ids):
        early = early | last
    seeds = rows.where(early).groupBy("vec_id").agg(F.min("q").alias("q")).collect() if ids else []
    seeds.sort(key=lambda r: (r["vec_id"] is None, r["vec_id"]))
    first_book = np.array([r["q"] for r in seeds], np.int64).reshape(len(seeds), parts, size // parts)
    history = [first_book.transpose(1, 0, 2)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = STATE.format(id=kinds["vec_id"], label=kinds["label"])
    state = materialize(_round(rows, history, schema))
    for _ in range(rounds):
        history.append(_means(state, history[-1]))
        following = materialize(_round(state.where("part IS NULL"), history, schema))
        discard(state)
        state = following
    return state.where("part IS NULL").select("vec_id", "label", "code", "error"), history[-1]


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over all rows of the same label, null being
    one label; null where the sum exceeds a long."""
    # written: the large side then keeps no tie to the aggregate and its hot labels can be split
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(
        F.try_sum("error").alias("label_error")))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")


def hex_code(code: str) -> Column:
    return F.lower(F.hex(code))
