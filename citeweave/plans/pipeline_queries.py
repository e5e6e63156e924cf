"""The pipelines and the stream operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import corpus as C
from citeweave.plans import pipeline as P
from citeweave.plans import sql_text as S
from citeweave.plans.evaluation_sql import DOCS
from citeweave.plans.retrieval_queries import _bm25_sql, _terms_sql, _top
from citeweave.runtime import table
from citeweave.streaming.ingest import arrival_counts as _arrivals


def pipeline_laws_first(spark: SparkSession, d: str) -> DataFrame:
    """Pipeline A for the stated query set."""
    wanted = C.questions(spark, d).where("row_id % 100 = 0")
    dense = C.hits(spark, d).where("list_id = 'dense_multi_view'").drop("list_id")
    return P.laws_first(wanted, C.corpus(spark, d), dense)


def pipeline_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Pipeline B for all questions over the recorded hits."""
    docs = C.doc_lookup(C.corpus(spark, d)).select(F.col("norm").alias("citation"), "source", T.joined(F.col("norm"), F.col("title"), F.col("text")).alias("body"))
    return P.baseline(C.hits(spark, d), C.questions(spark, d), docs, {"sparse_bm25": 0.6, "dense_multi_view": 0.4, "rule_exact": 0.35})


def pipeline_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Pipeline C for the stated query set."""
    return P.bm25_baseline(C.questions(spark, d).where("row_id % 100 = 0"), C.corpus(spark, d))


def arrival_counts(spark: SparkSession, d: str) -> DataFrame:
    return _arrivals(table(spark, d, "retrieved_item"), "retrieved_at", ["source"])


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The event table by type and day."""
    return _arrivals(table(spark, d, "events"), "ts", ["event_type"])


QUERIES = {f.__name__: f for f in (pipeline_laws_first, pipeline_baseline, pipeline_bm25, arrival_counts, event_windows)}

_OVERLAP = "len(list_distinct(list_intersect(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+'), regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+'))))"

SQL = {
    "pipeline_bm25": f"""WITH {S.CORPUS}, {S.QUESTIONS}, searched AS (SELECT * FROM questions WHERE row_id % 100 = 0), docs AS (SELECT 'all' AS grp, source, row_id, norm AS citation, concat_ws(' ', norm, title, text) AS body FROM corpus WHERE norm <> ''),
        {_terms_sql('terms', 'searched', 'query_id', 'query')}, {_bm25_sql('docs', 'grp, source, row_id, citation', 'grp', 'terms', 'query_id')}, best AS ({_top('scores', 'query_id', 'score DESC, source, row_id', 50)}),
        f AS (SELECT query_id, citation, min(rank) AS first_ FROM best GROUP BY ALL) {_top('f', 'query_id', 'first_', 8, 'query_id, citation')}""",
    "pipeline_baseline": f"""WITH {S.CORPUS}, {DOCS}, {S.QUESTIONS}, {S.HITS}, w(list_id, w) AS (VALUES ('sparse_bm25', 0.6), ('dense_multi_view', 0.4), ('rule_exact', 0.35)),
        spread AS (SELECT *, min(score) OVER (PARTITION BY query_id, list_id) AS lo, max(score) OVER (PARTITION BY query_id, list_id) AS hi FROM hits),
        f AS (SELECT query_id, citation, round(sum(CAST(w AS DOUBLE) * (score - lo) / (hi - lo + 1e-9)), 6) AS fused_score FROM spread JOIN w USING (list_id) GROUP BY ALL), p AS ({_top('f', 'query_id', 'fused_score DESC, citation', 40, '*', 'fused_rank')}),
        r AS (SELECT p.*, q.query, docs.d.source AS source, coalesce(concat_ws(' ', p.citation, docs.d.title, docs.d.text), p.citation) AS body FROM p JOIN questions q USING (query_id) LEFT JOIN docs ON docs.norm = p.citation),
        s AS (SELECT *, round(fused_score + 0.02::DOUBLE * {_OVERLAP} + CASE source WHEN 'laws_de' THEN 0.005::DOUBLE ELSE 0.0::DOUBLE END, 6) AS rerank_score FROM r)
        {_top('s', 'query_id', 'rerank_score DESC, fused_rank, citation', 10, 'query_id, citation')}""",
    "arrival_counts": "SELECT time_bucket(INTERVAL 1 day, retrieved_at) AS window_start, source, count(*) AS n FROM retrieved_item WHERE retrieved_at IS NOT NULL GROUP BY ALL",
    "event_windows": "SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}
