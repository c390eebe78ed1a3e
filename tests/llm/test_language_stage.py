"""The language stage keeps documents of a table with many languages."""

import zlib

import numpy as np

import corpus_pipeline
from waterloom.llm import langid


def test_clean_short_documents_of_many_languages_stay(spark, monkeypatch):
    langs = [f"l{i:02d}" for i in range(12)]
    table = np.zeros((langid.BUCKETS, len(langs)), np.float32)
    table[:, 3] = 0.5  # the best of twelve has a probability of about 0.13
    monkeypatch.setattr(langid, "fit", lambda docs: {"langs": langs, "table": table})
    rows = [(1, "short text", "l03"), (2, "two languages dos lenguas", "l03"), (3, "123 --", "l03"),
            (4, None, "l03")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    _, score = langid.score_texts({"langs": langs, "table": table}, [r[1] for r in rows[:2]])
    assert (score < 0.3).all()
    kept = corpus_pipeline.keep_language(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_every_document_is_learned_from(spark):
    """A third of the ids by crc32, which the stage once left out, is learned from like the rest."""
    third = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, f"eine kleine zeile nummer {i}", "de") for i in third]
    rows += [(i + 1000, f"une petite ligne de texte {i}", "fr") for i in third
             if zlib.crc32(str(i + 1000).encode()) % 3 == 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.keep_language(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in rows)
