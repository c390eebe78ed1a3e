"""Training-text preparation over ``documents`` as a chain of stages.

Each stage is written as Parquet in the shared folder and read again, so a lost executor costs the
running stage at most.  All stages but the last return the columns of ``documents``; each learns
from, and decides on, all rows that the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waterloom.llm import langid, packing, quality, resemble, winnow
from waterloom.llm.common import fresh, id_remainder, table
from waterloom.session import discard, materialize, scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels held out by id are not learned."""
    labels = table(spark, sf_dir, "labels").where(
        F.coalesce(id_remainder("doc_id", 5) != 0, F.lit(True)))
    model = quality.fit(docs, labels)
    score = fresh(docs, "score")
    scored = docs.withColumn(score, quality.score(spark, model, "text"))
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, however sure; those without letters go.  Nothing
    is scored against held-out labels here, so every document counts for what is learned."""
    model = langid.fit(docs)
    found = fresh(docs, "language")
    scored = docs.withColumn(found, langid.predict(spark, model, "text"))
    return scored.where(F.col(f"{found}.lang_pred") != langid.UNKNOWN).drop(found)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity of
    0.8 and more), the one of the smallest id.  op1's fingerprint links come first, each confirmed
    by the similarity; MinHash finds the copies that are more than two bits apart."""
    return resemble.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty stand in a benchmark window."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 4096 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_first_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: The models and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages one after the other, each over what the one before has written."""
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch(lambda: materialize(stage(spark, docs, sf_dir)))()
        if written is not None:
            discard(written)
        written = docs
    return docs
