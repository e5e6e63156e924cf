"""Combining ranked and scored lists. Long format throughout: (query, list, rank or score, citation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.sparse import top_k
from citeweave.runtime import cut_lineage, shuffle_partitions


def rank_lists(hits: DataFrame, cut: int | None = None) -> DataFrame:
    """Ranks inside every list by (score, citation, source); ``cut`` bounds the lists."""
    order = Window.partitionBy("query_id", "list_id").orderBy(F.desc("score"), "citation", "source")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= cut) if cut is not None else ranked


def rank_whole(hits: DataFrame) -> DataFrame:
    """The ranks of ``rank_lists`` for lists of any length: rows are spread by ranges of the order, so a hot list takes
    many tasks; each counts on from the rows of its list in the ranges before."""
    lists = ["query_id", "list_id"]
    order = [F.desc("score"), F.asc("citation"), F.asc("source")]
    spread = hits.repartitionByRange(shuffle_partitions(hits.sparkSession), *lists, *order).withColumn("_p", F.spark_partition_id())
    # Materialised, so that both readers see the same ranges.
    rows = cut_lineage(spread)
    counts = rows.groupBy(*lists, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*lists).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*lists, "_p").orderBy(*order)))
    return local.join(counts, [*lists, "_p"]).withColumn("rank", (F.col("rank") + F.col("_before")).cast("int")).drop("_p", "_before")


def source_factor(laws: float, court: float) -> Column:
    """F3."""
    return F.when(F.col("source") == "laws_de", F.lit(laws)).when(F.col("source") == "court_considerations", F.lit(court)).otherwise(F.lit(1.0))


def reciprocal_rank(lists: DataFrame, top_n: int, k: int = 60, laws: float = 1.0, court: float = 1.0) -> DataFrame:
    """sum of 1 / (k + rank) over all lists; a citation repeated in a list counts each time.

    Ties go to the citation that sorts first.
    """
    scored = lists.groupBy("query_id", "citation").agg(F.round(F.sum(source_factor(laws, court) / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("citation")], top_n)


def min_max(hits: DataFrame, weights: dict[str, float], top_n: int, laws: float = 1.0, court: float = 1.0) -> DataFrame:
    """F2: scores of each list spread over 0..1, weighted and summed; a list of one score contributes 0."""
    if not weights:
        raise ValueError("weights must name at least one list")
    of_list = Window.partitionBy("query_id", "list_id")
    low, high = F.min("score").over(of_list), F.max("score").over(of_list)
    weight = F.coalesce(*[F.when(F.col("list_id") == name, F.lit(w)) for name, w in weights.items()])
    parts = hits.withColumn("_part", weight * (F.col("score") - low) / (high - low + 1e-9) * source_factor(laws, court)).where("_part IS NOT NULL")
    scored = parts.groupBy("query_id", "citation").agg(F.round(F.sum("_part"), 6).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("citation")], top_n)


def branch_metadata(lists: DataFrame, main: str) -> DataFrame:
    """which lists found a citation, and its rank among the distinct citations of the main list (none: 10^9)."""
    branches = lists.groupBy("query_id", "citation").agg(
        F.countDistinct("list_id").alias("n_branches"), F.max(F.col("list_id") == main).alias("in_main"), F.min(F.when(F.col("list_id") == main, F.col("rank"))).alias("_first")
    )
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("_first"))
    placed = branches.withColumn("main_rank", F.when(F.col("in_main"), F.row_number().over(order)).otherwise(10**9))
    return placed.drop("_first")


def branch_aware(base: DataFrame, meta: DataFrame, top_n: int, mode: str, bonus: float, single_bonus: float, rank_cut: int = 200) -> DataFrame:
    """base scores (all ranks) times 1 + bonus for what the main branch found, ranked again.

    ``bonus`` mode rewards every hit of the main branch, single hits more; ``rescue`` mode only single hits beyond the
    first ``top_n`` that the main branch ranks within ``rank_cut``.
    """
    single = F.col("n_branches") == 1
    if mode == "bonus":
        extra = F.when(F.col("in_main"), F.lit(max(bonus, 0.0)) + F.when(single, F.lit(max(single_bonus, 0.0))).otherwise(0.0)).otherwise(0.0)
    elif mode == "rescue":
        rescued = F.col("in_main") & single & (F.col("main_rank") <= max(rank_cut, 1)) & (F.col("rank") > max(top_n, 1))
        extra = F.when(rescued, F.lit(max(bonus, 0.0) + max(single_bonus, 0.0))).otherwise(0.0)
    else:
        raise ValueError(f"unknown mode {mode}")
    scored = base.join(meta, ["query_id", "citation"], "left").withColumn("base_rank", F.col("rank"))
    scored = scored.select("query_id", "citation", "base_rank", F.round(F.col("score") * (1.0 + F.coalesce(extra, F.lit(0.0))), 6).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("base_rank")], top_n)


def keep_best(hits: DataFrame, keys: list[str]) -> DataFrame:
    """the best score of every key."""
    return hits.groupBy(*keys).agg(F.max("score").alias("score"))


def merge_lists(hits: DataFrame, order: list[str]) -> DataFrame:
    """F8: best score of every (citation, source); among equal scores the earlier list names the method."""
    place = F.coalesce(*[F.when(F.col("list_id") == name, i) for i, name in enumerate(order)], F.lit(len(order)))
    best = F.min_by("list_id", F.struct((-F.col("score")).alias("s"), place.alias("p"), F.col("list_id")))
    return hits.groupBy("query_id", "citation", "source").agg(F.max("score").alias("score"), best.alias("method"))


def first_occurrences(lists: DataFrame, cut: int) -> DataFrame:
    """a ranked list without repetitions, cut."""
    once = lists.groupBy("query_id", "citation").agg(F.min("rank").alias("_first"))
    return top_k(once, ["query_id"], [F.asc("_first"), F.asc("citation")], cut).drop("_first")


def court_fusion(sparse: DataFrame, dense: DataFrame, dense_weight: float, top_n: int) -> DataFrame:
    """reciprocal ranks counted from 0, the dense list weighted."""
    both = sparse.withColumn("_w", F.lit(1.0)).unionByName(dense.withColumn("_w", F.lit(dense_weight)))
    scored = both.groupBy("query_id", "citation").agg(F.round(F.sum(F.col("_w") / (59.0 + F.col("rank"))), 6).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("citation")], top_n)


def family_match(families: str = "families") -> Column:
    """The citation's family is among the predicted ones."""
    return F.array_contains(F.col(families), F.nullif(T.family_first("citation"), F.lit("")))


def family_boost(hits: DataFrame, boost: float, suffix: str = "_family") -> DataFrame:
    """scores of matching families times the boost (at least 1), their method marked, every list ranked again. Needs
    ``families`` on every row; gives ``method`` and ``rank``."""
    matched = F.coalesce(family_match(), F.lit(False))
    boosted = hits.withColumns({"score": F.when(matched, F.col("score") * max(1.0, boost)).otherwise(F.col("score")), "method": F.when(matched, F.concat("list_id", F.lit(suffix))).otherwise(F.col("list_id"))})
    return rank_whole(boosted)


def family_constrain(hits: DataFrame, min_keep: int = 5) -> DataFrame:
    """only matching families, if at least ``min_keep`` rows of the query match; else all rows."""
    matched = F.coalesce(family_match(), F.lit(False))
    count = F.count_if(matched).over(Window.partitionBy("query_id"))
    return hits.withColumn("_m", matched).withColumn("_c", count).where((F.col("_c") < min_keep) | F.col("_m")).drop("_m", "_c")


def family_filter(hits: DataFrame) -> DataFrame:
    """only matching families, where any are predicted."""
    return hits.where((F.size("families") == 0) | F.coalesce(family_match(), F.lit(False)))


def federated(hits: DataFrame, cut: int = 5) -> DataFrame:
    """The best hits that cite a decision."""
    decisions = hits.where(F.contains("citation", F.lit("BGE")) | F.contains("citation", F.lit("_")) | F.contains("citation", F.lit("/")))
    return top_k(decisions, ["query_id"], [F.desc("score"), F.asc("citation"), F.asc("source"), F.asc("list_id")], cut)


def three_way(sparse: DataFrame, dense: DataFrame, court: DataFrame, top_n: int = 320, k: int = 60) -> DataFrame:
    """reciprocal ranks of the sparse laws, the dense laws and the fused court list; a query without a court list falls
    back to both lists whole. ``sparse``, ``dense``: query_id, source, citation, rank, laws_rank; ``court``: query_id,
    citation, rank. Gives query_id, citation, score, rank, mode."""
    known = court.select("query_id").distinct().withColumn("_court", F.lit(True))
    parts = []
    for rows in (sparse, dense):
        rows = rows.join(known, "query_id", "left")
        placed = F.when(F.col("_court").isNull(), F.col("rank")).when(F.col("source") == "laws_de", F.col("laws_rank"))
        parts.append(rows.select("query_id", "citation", placed.alias("rank"), F.col("_court").isNotNull().alias("three")).where("rank IS NOT NULL"))
    both = parts[0].unionByName(parts[1]).unionByName(court.select("query_id", "citation", "rank", F.lit(True).alias("three")))
    scored = both.groupBy("query_id", "citation").agg(F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"), F.bool_or("three").alias("three"))
    mode = F.when(F.col("three"), "court_dense_threeway_rrf").otherwise("fallback_full_rrf_due_empty_court_rank")
    return top_k(scored.select("query_id", "citation", "score", mode.alias("mode")), ["query_id"], [F.desc("score"), F.asc("citation")], top_n)
