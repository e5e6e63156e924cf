"""Reranking, cutting and selecting candidates. One row per (query_id, citation) with the columns each step names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.sparse import top_k

#: A reranker takes candidates with ``query``, ``body``, ``source`` and ``fused_score`` and adds ``rerank_score``.
Reranker = Callable[[DataFrame], DataFrame]


def no_rerank(candidates: DataFrame) -> DataFrame:
    """R1."""
    return candidates.withColumn("rerank_score", F.col("fused_score"))


def token_overlap(candidates: DataFrame) -> DataFrame:
    """R2: 0.02 for every distinct word that query and candidate share, 0.005 for laws."""
    shared = F.size(F.array_intersect(T.tokens("query"), T.tokens("body")))
    bonus = F.when(F.col("source") == "laws_de", 0.005).otherwise(0.0)
    return candidates.withColumn("rerank_score", F.round(F.col("fused_score") + 0.02 * shared + bonus, 6))


def scored_by(model: Callable[[Column, Column], Column]) -> Reranker:
    """Any scoring column over (query, body), such as a pandas UDF that hosts a cross-encoder."""
    return lambda candidates: candidates.withColumn("rerank_score", model(F.col("query"), F.col("body")))


def resolve_reranker(strong: Reranker | None) -> tuple[Reranker, str]:
    """The strong reranker if there is one, else word overlap, with the reason."""
    return (strong, "strong") if strong else (token_overlap, "no strong reranker given")


def rerank(candidates: DataFrame, reranker: Reranker, top_n: int) -> DataFrame:
    """Candidates in the reranker's order; equal scores keep their fused order."""
    return top_k(reranker(candidates), ["query_id"], [F.desc("rerank_score"), F.asc("fused_rank"), F.asc("citation")], top_n, "rerank_rank")


def calibrate(reranked: DataFrame, top_n: int = 80) -> DataFrame:
    """Among the first ``top_n``, laws gain or lose by the evidence for them and are sorted again; the rest follows."""
    evidence = 0.08 * F.col("is_rule") + 0.04 * F.col("is_rule") + 0.03 * F.col("is_family") + 0.03 * F.col("is_issue") + 0.05 * F.col("is_both") - 0.04 * F.col("is_dense_only")
    head = F.col("rerank_rank") <= top_n
    score = F.when(head & (F.col("source") == "laws_de"), F.col("rerank_score") + evidence).otherwise(F.col("rerank_score"))
    rows = reranked.withColumn("calibrated_score", F.round(score, 6))
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.col("calibrated_score")), "rerank_rank")
    return rows.withColumn("calibrated_rank", F.row_number().over(order))


def cut(reranked: DataFrame, mode: str, fixed: int, threshold: float = 0.15, relative: float = 0.85) -> DataFrame:
    """``fixed``, ``score`` (at least ``threshold``) or ``relative`` (at least the best times ``relative``); a query
    that would keep nothing keeps the first ``fixed``. Unknown modes cut like ``fixed``."""
    of_query = Window.partitionBy("query_id")
    if mode == "score":
        passes = F.col("rerank_score") >= threshold
    elif mode == "relative":
        passes = F.col("rerank_score") >= F.max("rerank_score").over(of_query) * relative
    else:
        return reranked.where(F.col("rerank_rank") <= fixed)
    rows = reranked.withColumn("_pass", passes)
    rows = rows.withColumn("_any", F.max("_pass").over(of_query))
    return rows.where(F.col("_pass") | (~F.col("_any") & (F.col("rerank_rank") <= fixed))).drop("_pass", "_any")


def rescue(fused: DataFrame, final: DataFrame, top_n: int = 1) -> DataFrame:
    """For queries that are not explicit and have families, the next ``top_n`` fused laws of such a family that are
    not final yet. Needs ``explicit``, ``is_family`` and ``source`` on the fused rows."""
    eligible = fused.where(~F.col("explicit") & (F.col("is_family") == 1) & (F.col("source") == "laws_de"))
    left = eligible.join(final.select("query_id", "citation"), ["query_id", "citation"], "left_anti")
    return top_k(left, ["query_id"], [F.asc("fused_rank")], top_n, "rescue_rank")


def ordered_union(*segments: DataFrame) -> DataFrame:
    """Citations of the segments one after the other, first occurrences: query_id, citation, rank.

    Each segment: query_id, citation, rank.
    """
    parts = [s.select("query_id", "citation", F.struct(F.lit(i).alias("segment"), F.col("rank").cast("int").alias("rank")).alias("at")) for i, s in enumerate(segments)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = rows.groupBy("query_id", "citation").agg(F.min("at").alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "citation")
    return first.select("query_id", "citation", F.row_number().over(order).alias("rank"))


def shape_input(pool: DataFrame, shortlist: int = 320, fused_tail: int = 160) -> DataFrame:
    """Which candidates the reranker sees, in order: laws with evidence by priority up to the budget (the shortlist
    less the tail, but at least one), then fused order, then what is left by priority.

    ``pool``: query_id, citation, is_laws, is_rule, is_family, is_issue, fused_rank (10^9 if not fused), pool_score.
    """
    budget = max(1, shortlist - fused_tail)
    family, issue, rule = F.col("is_family") == 1, F.col("is_issue") == 1, F.col("is_rule") == 1
    tier = F.when(family & issue, 4).when(rule, 3).when(family, 2).when(issue, 1).otherwise(0)
    priority = [F.desc(c) for c in ("is_laws", "tier", "is_rule", "is_family", "is_issue")] + [F.asc("fused_rank"), F.desc("pool_score"), F.asc("citation")]
    rows = pool.withColumn("tier", tier).withColumn("_first", (F.col("is_laws") == 1) & (F.col("tier") > 0))
    by_priority = Window.partitionBy("query_id", "_first").orderBy(*priority)
    rows = rows.withColumn("_p", F.row_number().over(by_priority))
    segment = F.when(F.col("_first") & (F.col("_p") <= budget), 0).when(F.col("fused_rank") < 10**9, 1).otherwise(2)
    rows = rows.withColumn("_segment", segment)
    order = Window.partitionBy("query_id").orderBy("_segment", F.when(F.col("_segment") == 0, F.col("_p")), F.when(F.col("_segment") == 1, F.col("fused_rank")), *priority)
    return rows.withColumn("input_rank", F.row_number().over(order)).where(F.col("input_rank") <= shortlist).drop("_first", "_p", "_segment")


def cut_logits(reranked: DataFrame, mode: str, top: int = 3, share: float = 0.8) -> DataFrame:
    """Cuts over scores whose sign tells: ``positive`` keeps scores above 0, ``top`` the first ``top``, ``adaptive`` all
    that reach ``share`` of a positive best score, else the best alone."""
    if mode == "positive":
        return reranked.where(F.col("rerank_score") > 0)
    if mode == "top":
        return reranked.where(F.col("rerank_rank") <= top)
    if mode != "adaptive":
        raise ValueError(f"unknown mode {mode}")
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    rows = reranked.withColumn("_best", best)
    return rows.where(F.when(F.col("_best") > 0, F.col("rerank_score") >= F.col("_best") * share).otherwise(F.col("rerank_rank") == 1)).drop("_best")


def fill_empty(queries: DataFrame, rows: DataFrame, default: str) -> DataFrame:
    """query_id, citation; a query without a citation gets the default one."""
    return queries.select("query_id").join(rows.select("query_id", "citation"), "query_id", "left").select("query_id", F.coalesce("citation", F.lit(default)).alias("citation"))
