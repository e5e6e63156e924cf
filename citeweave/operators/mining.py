"""Training examples for a retrieval encoder: a positive and a hard negative for every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.functions import understanding as U


def hard_negatives(views: DataFrame, gold: DataFrame, candidates: DataFrame, docs: DataFrame, seed: int = 42) -> DataFrame:
    """M1, M2: query_id, positive, negative, negative_rank, same_family, issue_overlap.

    The negative is the candidate law that is no gold and shares most issue words with the query (if any does), then one
    of the gold's family, then the best ranked. The positive is drawn from the gold laws by a hash of query, citation and
    seed. ``docs``: citation and small-letter text of laws. Queries without gold laws or without a negative have no row.
    """
    families = U.likely_families("query")
    terms = F.filter(F.transform(U.issue_terms(U.issue_groups("query", families)), lambda t: F.lower(t)), lambda t: F.length(t) >= 4)
    fallback = F.filter("words", lambda w: F.length(w) >= 4)
    queries = views.select("query_id", F.slice(F.when(F.size(terms) > 0, terms).otherwise(fallback), 1, 16).alias("terms"))
    laws = gold.join(docs, "citation", "left_semi")
    positives = laws.groupBy("query_id").agg(F.min_by("citation", F.xxhash64("query_id", "citation", F.lit(seed))).alias("positive"), F.collect_set(F.nullif(T.family_first("citation"), F.lit(""))).alias("gold_families"))
    pool = candidates.join(gold.select("query_id", "citation"), ["query_id", "citation"], "left_anti").join(docs, "citation").join(queries, "query_id").join(positives, "query_id")
    overlap = F.size(F.filter("terms", lambda t: F.contains("text", t)))
    pool = pool.withColumn("issue_overlap", overlap).withColumn("same_family", F.coalesce(F.array_contains("gold_families", T.family_first("citation")), F.lit(False)).cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("issue_overlap"), F.desc("same_family"), "rank")
    best = pool.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select("query_id", "positive", F.col("citation").alias("negative"), F.col("rank").alias("negative_rank"), "same_family", "issue_overlap")


def training_query(views: DataFrame) -> DataFrame:
    """M5: the query as a trainer sees it: clean text, family and issue terms."""
    families = U.likely_families("query")
    return views.select("query_id", T.joined(F.col("clean"), F.slice(U.family_terms(families), 1, 16), U.issue_terms(U.issue_groups("query", families))).alias("text"))


def family_negatives(gold: DataFrame, candidates: DataFrame, laws: DataFrame, prefer_family: bool) -> DataFrame:
    """M1 without issues: query_id, negative, negative_rank, same_family: the best ranked law that is no gold, of the gold's
    family first if ``prefer_family``. ``candidates``: query_id, citation, rank; ``laws``: citation."""
    wanted = gold.join(laws, "citation", "left_semi").groupBy("query_id").agg(F.collect_set(F.nullif(T.family_first("citation"), F.lit(""))).alias("gold_families"))
    pool = candidates.join(gold.select("query_id", "citation"), ["query_id", "citation"], "left_anti").join(laws, "citation", "left_semi").join(wanted, "query_id")
    pool = pool.withColumn("same_family", F.coalesce(F.array_contains("gold_families", T.family_first("citation")), F.lit(False)).cast("int"))
    order = ([F.desc("same_family")] if prefer_family else []) + [F.asc("rank")]
    return pool.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("_n = 1").select("query_id", F.col("citation").alias("negative"), F.col("rank").alias("negative_rank"), "same_family")


def first_wrong(gold: DataFrame, ranked: DataFrame, depth: int = 15) -> DataFrame:
    """M3: the first of the ``depth`` best hits that is no gold, for queries with gold: query_id, negative, negative_rank."""
    pool = ranked.where(F.col("rank") <= depth).join(gold.select("query_id").distinct(), "query_id", "left_semi").join(gold.select("query_id", "citation"), ["query_id", "citation"], "left_anti")
    return pool.groupBy("query_id").agg(F.min_by(F.struct("citation", "rank"), F.struct("rank", "citation")).alias("d")).select("query_id", F.col("d.citation").alias("negative"), F.col("d.rank").alias("negative_rank"))
