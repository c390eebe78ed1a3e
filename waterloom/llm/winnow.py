"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of ``span`` words holds ``span - k + 1`` k-grams; the smallest k-gram hash of each
window is kept, on the document's side and on the benchmark's.  Two texts that share a window of
words therefore keep one k-gram in common at the same place of the window (all equal minima are
kept, so ties cannot part them), and joining on kept hashes finds every shared window.  A hit is
then extended over the words around it, which each kept k-gram carries along: words, not hashes,
decide.

Items shorter than the window are one window of their own length; each such length present in the
benchmark (at most ``span - 1`` of them) gets its own hashes, so they are found by the same join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterloom.llm.common import fresh, let
from waterloom.session import materialize, scratch

SPAN = 13
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case (A-Z only) words; null for a null text."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    """Number of words, without making them; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_ANY_CASE)), F.lit(0)).cast("bigint")


def _kept(w: Column, span: int, gram: int, around: bool) -> Column:
    """Array of kept k-grams: span, hash and place, with ``around`` also the number of words, the
    words around, and where the k-gram starts in them."""
    k = min(gram, span)
    win = span - k + 1
    n = F.size(w)

    def pick(g: Column, m: Column) -> Column:
        def first(i):
            return F.greatest(i - (win - 1), F.lit(0))
        places = F.filter(
            F.sequence(F.lit(0), n - k),
            lambda i: F.array_contains(F.slice(m, first(i) + 1, i - first(i) + 1), g[i]),
        )
        more = (lambda i: [
            n.cast("bigint").alias("n_words"), (i - first(i)).alias("inset"),
            F.slice(w, first(i) + 1, i - first(i) + k + win - 1).alias("around")]
        ) if around else (lambda i: [])
        return F.transform(places, lambda i: F.struct(
            F.lit(span).alias("span"), g[i].alias("hash"), i.alias("place"), *more(i)))

    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.slice(w, i + 1, k)))

    def minima(g: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n - span), lambda i: F.array_min(F.slice(g, i + 1, win)))

    return F.when(n >= span, let(grams, lambda g: let(minima(g), lambda m: pick(g, m))))


def kept_grams(
    df: DataFrame, keys: list[str], text: str, spans: list[int], gram: int = GRAM
) -> DataFrame:
    """One row per kept k-gram: the keys, n_words, span, hash, place, inset, around.

    Texts that are null, or shorter than every span, have none.
    """
    kept = let(words(F.col(text)), lambda w: F.flatten(F.array(*[
        F.coalesce(_kept(w, s, gram, True), F.array()) for s in spans])))
    # outer: of an inner explode the optimizer infers filters that compute the array again
    return df.select(*keys, F.explode_outer(kept).alias("g")).select(*keys, "g.*").where(
        F.col("hash").isNotNull())


def kept_hashes(
    df: DataFrame, keys: list[str], text: str, spans: list[int], gram: int = GRAM
) -> DataFrame:
    """One row per kept k-gram (the keys, span, hash, place), and before them one row per text
    with place -1 and the number of its words as ``span``; null texts have none."""
    def of(w):
        head = F.struct(F.size(w).alias("span"), F.xxhash64(*keys).alias("hash"),
                        F.lit(-1).alias("place"))
        return F.flatten(F.array(F.array(head), *[
            F.coalesce(_kept(w, s, gram, False), F.array()) for s in spans]))

    kept = let(F.coalesce(words(F.col(text)), F.array().cast("array<string>")), of)
    return df.select(*keys, F.explode_outer(kept).alias("g")).select(*keys, "g.*")


def _extended(span: Column, win: Column) -> Column:
    """Shifts at which the whole window around a joined k-gram is equal on both sides."""
    def same(o):
        a = F.slice("around", F.col("inset") - o + 1, span)
        b = F.slice("item_around", F.col("item_inset") - o + 1, span)
        return (F.size(a) == span) & (a == b)
    upto = F.least("inset", "item_inset", win - 1)
    return F.filter(F.sequence(F.lit(0), upto), same)


def _item_grams(
    benchmark: DataFrame, item_id: str, item_text: str, span: int, gram: int,
) -> tuple[DataFrame, list[int]]:
    """Kept k-grams of the items (span, hash, item, item_inset, item_around), and the spans."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"),
                             F.col(item_text).alias("item_text"))
    n = word_count(F.col("item_text"))
    # at most `span` values, whatever the benchmark's size
    spans = sorted(r[0] for r in items.select(F.least(n, F.lit(span)).cast("int").alias("s"))
                   .where("s > 0").distinct().collect())
    schema_only = items.limit(0) if not spans else items
    sides = [materialize(kept_grams(
        schema_only.where(F.least(word_count(F.col("item_text")), F.lit(span)) == s),
        ["item"], "item_text", [s], gram,
    )) for s in spans or [span]]
    grams = sides[0]
    for more in sides[1:]:
        grams = grams.unionByName(more)
    # written first: the optimizer sees the size and broadcasts only below its threshold
    return grams.select("span", "hash", "item", F.col("inset").alias("item_inset"),
                        F.col("around").alias("item_around")), spans or [span]


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.col(text).alias("text"))


def _marks(docs: DataFrame, grams: DataFrame, spans: list[int], gram: int) -> DataFrame:
    """Per row of ``docs`` its number of words (place -1), and a row per kept k-gram that an item
    has too: doc_id, text_hash, span, place."""
    hashes = materialize(grams.select("span", "hash", F.lit(True).alias("known")).distinct())
    rows = kept_hashes(docs, ["doc_id", "text_hash"], "text", spans, gram)
    found = rows.join(hashes, ["span", "hash"], "left").where("known OR place = -1")
    return materialize(found.select("doc_id", "text_hash", "span", "place"))


def hits(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM,
) -> tuple[DataFrame, DataFrame]:
    """Documents that hold an item's window: doc_id, text_hash, n_words, n_hit, n_items, items,
    items_sha256, contaminated; one row per different (doc_id, text).  And the number of words of
    every row: doc_id, text_hash, n_words.

    Null texts and texts without words are never hit; an empty benchmark gives no hits; items
    without words are never found.  Repeated rows and rows that share an id keep apart by the
    hash of the text, and null ids are ids like others.  Extra columns are not read.
    """
    grams, spans = _item_grams(benchmark, item_id, item_text, span, gram)
    own = _own(docs, doc_id, text)
    marks = _marks(own, grams, spans, gram)
    sizes = marks.where("place = -1").select("doc_id", "text_hash",
                                             F.col("span").cast("bigint").alias("n_words"))
    touched = materialize(marks.where("place >= 0").select(
        F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash")).distinct())
    again = own.join(touched, own["doc_id"].eqNullSafe(touched["t_id"])
                     & (own["text_hash"] == touched["t_hash"]), "left_semi")
    found = kept_grams(again, ["doc_id", "text_hash"], "text", spans, gram).join(
        grams, ["span", "hash"])
    k = F.least(F.lit(gram), F.col("span"))
    shifts = _extended(F.col("span"), F.col("span") - k + 1)
    runs = found.select("doc_id", "text_hash", "n_words", "item", "span", "place",
                        shifts.alias("shifts")).where(F.size("shifts") > 0)
    # the equal windows around one k-gram overlap, so together they are one run of words
    runs = runs.select(
        "doc_id", "text_hash", "n_words", "item",
        F.struct((F.col("place") - F.array_max("shifts")).alias("lo"),
                 (F.col("place") - F.array_min("shifts") + F.col("span") - 1).alias("hi"))
        .alias("run"),
    ).distinct()
    union = F.aggregate(
        F.array_sort(F.collect_set("run")),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("end")),
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(
                r["hi"] - F.greatest(r["lo"], acc["end"] + 1) + 1, F.lit(0))).alias("n"),
            F.greatest(acc["end"], r["hi"]).alias("end")),
        lambda acc: acc["n"],
    )
    per = runs.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), union.alias("n_hit"),
        F.array_sort(F.collect_set("item")).alias("items"))
    return per.select(
        "*", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (20 * F.col("n_hit") >= F.col("n_words")).alias("contaminated"),
    ), sizes


@scratch
def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every document with its words, hit words and items; documents without hits have zeros."""
    found, sizes = hits(docs, benchmark, **options)
    found = materialize(found.select(
        F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "n_hit", "n_items",
        "items_sha256", "contaminated"))
    joined = sizes.join(found, sizes["doc_id"].eqNullSafe(found["hit_id"])
                        & (sizes["text_hash"] == found["hit_hash"]), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


@scratch
def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents, all columns kept as they are."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    bad = materialize(hits(docs, benchmark, **options)[0].where("contaminated")
                      .select("doc_id", "text_hash"))
    own_hash = fresh(docs, "text_hash")
    bad = bad.select(F.col("doc_id").alias(f"{own_hash}_id"),
                     F.col("text_hash").alias(f"{own_hash}_of"))
    keyed = docs.withColumn(own_hash, F.xxhash64(text))
    same = keyed[doc_id].eqNullSafe(bad[f"{own_hash}_id"]) & (
        keyed[own_hash] == bad[f"{own_hash}_of"])
    return keyed.join(bad, same, "left_anti").drop(own_hash)
