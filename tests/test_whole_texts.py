from __future__ import annotations

from citeweave.plans import evaluation_queries as EQ
from citeweave.plans import pipeline as P
from citeweave.plans import pipeline_queries as PQ

LATE = "wort " * 400 + "Spaetwort"


def corpus(spark):
    rows = [("laws_de", 1, "Art. 1 ZGB", "Art. 1 ZGB", "t", LATE), ("laws_de", 2, "Art. 2 ZGB", "Art. 2 ZGB", "t", "wort anders")]
    return spark.createDataFrame(rows, "source string, row_id long, citation string, norm string, title string, text string")


def test_bm25_pipeline_finds_what_stands_late(spark):
    questions = spark.createDataFrame([("q", "Spaetwort")], "query_id string, query string")
    assert [tuple(r) for r in P.bm25_baseline(questions, corpus(spark)).collect()] == [("q", 1, "Art. 1 ZGB")]


def test_laws_first_searches_whole_texts(spark):
    questions = spark.createDataFrame([("q", "Spaetwort")], "query_id string, query string")
    hits = P.field_search(P.C.fields_of(corpus(spark)), questions, "query", {"citation": 2.0, "title": 2.0, "text": 1.0}, 5).collect()
    assert [(r.source, r.citation) for r in hits] == [("laws_de", "Art. 1 ZGB")]


def test_laws_first_reranks_whole_texts(spark):
    questions = spark.createDataFrame([("q", "Spaetwort")], "query_id string, query string")
    bodies = []

    def reranker(rows):
        bodies.extend(r.body for r in rows.collect())
        return rows.withColumn("rerank_score", rows["fused_score"])

    P.laws_first(questions, corpus(spark), reranker=reranker).collect()
    assert [b for b in bodies if b.startswith("Art. 1 ")] == ["Art. 1 ZGB t " + LATE]


def test_baseline_and_mining_read_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(PQ.C, "corpus", lambda s, d: corpus(s))
    for name in ("hits", "questions", "gold"):
        monkeypatch.setattr(PQ.C, name, lambda s, d: None)
    monkeypatch.setattr(PQ.P, "baseline", lambda hits, queries, docs, weights: docs)
    assert any(r.body.endswith("Spaetwort") for r in PQ.pipeline_baseline(spark, "").collect())
    monkeypatch.setattr(EQ, "query_views", lambda s, d: None)
    monkeypatch.setattr(EQ.C, "hits", lambda s, d: corpus(s).selectExpr("'q' AS query_id", "'l' AS list_id", "source", "citation", "1.0D AS score"))
    monkeypatch.setattr(EQ.M, "hard_negatives", lambda views, gold, candidates, docs: docs)
    assert any(r.text.endswith("spaetwort") for r in EQ.hard_negatives(spark, "").collect())
