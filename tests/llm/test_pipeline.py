"""Stages on the small tables: what each keeps, and that the chain is their composition."""

import pytest
from pyspark.sql import functions as F
from test_resemble import partition, plain_groups

import corpus_pipeline
from waterloom.llm import langid, winnow
from waterloom.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stage_columns_and_decisions(spark, docs):
    known = docs.select("doc_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.schema.names == docs.schema.names, name
        kept = {r[0] for r in out.select("doc_id").collect()}
        gone = {r[0] for r in known.collect()} - kept
        assert len(kept) > 0.5 * docs.count(), name
        if name == "decontamination":
            flagged = winnow.contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert gone == {r[0] for r in flagged.where("contaminated").collect()}
        if name == "near_duplicates":
            rows = sorted((r.doc_id, r.text) for r in docs.collect())
            groups = partition(zip([i for i, _ in rows], plain_groups([t for _, t in rows])))
            assert kept == {g[0] for g in groups}
        if name == "language":
            assert all(r.lang_pred != langid.UNKNOWN for r in QUERIES["op2_language_id"](
                spark, DATA).where(F.col("doc_id").isin(list(kept)[:50])).collect())


def test_run_packs_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    per = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert per.where("n != t").count() == 0 and per.count() > 80


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(SQL) <= set(QUERIES)
