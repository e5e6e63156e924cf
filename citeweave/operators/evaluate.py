"""Measuring predictions against gold: all queries at once, one shuffle by (query, citation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T

KS = (10, 50, 100, 200)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def overlap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """query_id, gold_count, pred_count, tp over distinct citations."""
    marks = gold.select("query_id", "citation").distinct().withColumn("g", F.lit(1))
    once = marks.join(pred.select("query_id", "citation").distinct().withColumn("p", F.lit(1)), ["query_id", "citation"], "full").fillna(0, ["g", "p"])
    return once.groupBy("query_id").agg(F.sum("g").alias("gold_count"), F.sum("p").alias("pred_count"), F.sum(F.col("g") * F.col("p")).alias("tp"))


def per_query_f1(queries: DataFrame, gold: DataFrame, pred: DataFrame, lookup: DataFrame | None = None, corpus_aware: bool = False, empty: float = 0.0) -> DataFrame:
    """Counts, precision, recall and F1 of every query; ``empty`` is the score where gold and prediction are empty.

    With a lookup (norm, canonical) both sides are compared in canonical form; ``corpus_aware`` leaves out gold that the
    lookup does not know, which ``missing_gold`` counts either way. Predictions without a query are ignored.
    """
    if lookup is not None:
        names = lookup.select(F.col("norm").alias("citation"), "canonical")
        known = gold.join(names, "citation", "left")
        missing = known.groupBy("query_id").agg(F.count_if(F.col("canonical").isNull()).alias("missing_gold"))
        gold = known.where("canonical IS NOT NULL") if corpus_aware else known
        gold = gold.select("query_id", F.coalesce("canonical", "citation").alias("citation"))
        pred = pred.join(names, "citation", "left").select("query_id", F.coalesce("canonical", "citation").alias("citation"))
    else:
        missing = gold.select("query_id").distinct().withColumn("missing_gold", F.lit(0).cast("long"))
    rows = queries.select("query_id").join(overlap(gold, pred), "query_id", "left").join(missing, "query_id", "left").fillna(0)
    g, p, tp = F.col("gold_count"), F.col("pred_count"), F.col("tp")
    both_empty = (g == 0) & (p == 0)
    precision = F.when(both_empty, empty).otherwise(ratio(tp, p))
    recall = F.when(both_empty, empty).otherwise(ratio(tp, g))
    f1 = F.when(both_empty, empty).otherwise(ratio(2.0 * tp, g + p))
    return rows.select("query_id", "gold_count", "pred_count", "tp", (p - tp).alias("fp"), (g - tp).alias("fn"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "missing_gold")


def rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def summary(rows: DataFrame, mode: str) -> DataFrame:
    """Macro-F1 over unrounded scores and the mean of missing gold."""
    return rows.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("queries"), F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 6).alias("macro_f1"), F.round(F.coalesce(F.avg("missing_gold"), F.lit(0.0)), 6).alias("avg_missing_gold"))


def hit_ranks(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every gold citation with its least rank in a ranked list (NULL: not there)."""
    best = ranked.groupBy("query_id", "citation").agg(F.min("rank").alias("rank"))
    return gold.join(best, ["query_id", "citation"], "left")


def branch_hit_ranks(gold: DataFrame, ranked: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """The same for every named list: query_id, list_id, citation, rank."""
    best = ranked.groupBy("query_id", "list_id", "citation").agg(F.min("rank").alias("rank"))
    wanted = gold.withColumn("list_id", F.explode(F.array(*[F.lit(b) for b in branches])))
    return wanted.join(best, ["query_id", "list_id", "citation"], "left")


def recall_rows(queries: DataFrame, ranks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Recall at every k and the rank of the first hit (-1: none); no gold gives 0."""
    keys = keys or ["query_id"]
    hits = [F.round(F.count_if(F.col("rank") <= k) / F.count(F.lit(1)), 6).alias(f"recall_at_{k}") for k in KS]
    rows = ranks.groupBy(*keys).agg(*hits, F.min("rank").alias("first_hit_rank"))
    if keys == ["query_id"]:
        rows = queries.select("query_id").join(rows, "query_id", "left")
    return rows.withColumn("first_hit_rank", F.coalesce("first_hit_rank", F.lit(-1))).fillna(0.0, subset=[f"recall_at_{k}" for k in KS])


def source_type(has_laws: Column, has_court: Column, has_other: Column) -> Column:
    """N38."""
    return F.when(has_laws & ~has_court & ~has_other, "laws_only").when(has_court & ~has_laws & ~has_other, "court_only").when(~has_laws & ~has_court, "unknown").otherwise("mixed")


def failure_type(branch_source: Column, gold_source: Column, gold_known: Column, mismatch: Column, first_hit: Column, at_200: Column) -> Column:
    """Why a branch missed, first reason that applies."""
    return (
        F.when(mismatch, "normalization_mismatch")
        .when(gold_known == 0, "no_gold_in_candidates")
        .when((branch_source == "laws_de") & (gold_source == "court_only"), "source_mismatch")
        .when((branch_source == "court_considerations") & (gold_source == "laws_only"), "source_mismatch")
        .when(at_200 == 0, "no_gold_in_candidates")
        .when(first_hit > 50, "gold_only_after_large_k")
        .otherwise("ok")
    )


def failure_cascade(
    branch: Column, known: Column, first_hit: Column, at_200: Column, gap: Column, pattern_missed: Column, mismatch: Column, sources: Column, in_union: Column, in_fusion: Column, in_final: Column
) -> Column:
    """Why a branch gave no gold, all nine labels, first reason that applies. ``first_hit`` is -1 for none;
    ``sources`` are the sources of the known gold (``laws_only`` and so on)."""
    missed = first_hit == -1
    return (
        F.when(known == 0, "no_gold_in_candidates")
        .when(missed & gap, "query_language_gap")
        .when(missed & pattern_missed, "citation_pattern_missed")
        .when(mismatch, "normalization_mismatch")
        .when(F.endswith(branch, F.lit("laws")) & (sources == "court_only"), "source_mismatch")
        .when(F.endswith(branch, F.lit("court")) & (sources == "laws_only"), "source_mismatch")
        .when((branch == "fusion_final") & in_union & ~in_fusion, "gold_lost_in_fusion")
        .when(at_200 == 0, "no_gold_in_candidates")
        .when(first_hit > 50, "gold_only_after_large_k")
        .when((branch == "fusion_final") & in_fusion & ~in_final, "gold_lost_in_final_cut")
        .otherwise("ok")
    )


def seed_miss_reason(hit: Column, pool: Column, dense_wanted: Column, dense_ran: Column, quota: Column, sparse: Column, dense: Column, anchored: Column, fallback: Column) -> Column:
    """E22, all nine labels: why gold is not among the candidates, first reason that applies."""
    return (
        F.when(hit, "hit_in_fused_top200")
        .when(pool < 200, "candidate_pool_too_shallow")
        .when(dense_wanted & ~dense_ran, "dense_not_triggered")
        .when(quota == 0, "blocked_by_route_quota")
        .when(~sparse & ~dense & anchored, "needs_anchor_rule")
        .when(~sparse & ~dense, "not_retrieved_sparse")
        .when(sparse & ~dense, "not_retrieved_dense")
        .when(dense & ~sparse, "not_retrieved_sparse")
        .when(fallback, "lost_in_merge")
        .otherwise("eval_alignment_suspected")
    )


def drop_stage(in_final: Column, fused_rank: Column, in_input: Column, after: Column, fixed_top_k: int) -> Column:
    """Where a gold citation was lost."""
    return (
        F.when(in_final, "kept_final").when(~in_input, "not_in_rerank_input").when(after.isNull(), "not_reranked").when(after > fixed_top_k, "reranked_too_low").otherwise("cut_by_dynamic_threshold")
    )


def miss_reason(hit: Column, pool: Column, quota: Column, sparse: Column, dense: Column, anchored: Column) -> Column:
    """Why gold is not among the candidates, first reason that applies."""
    return (
        F.when(hit, "hit_in_fused_top200")
        .when(pool < 200, "candidate_pool_too_shallow")
        .when(quota == 0, "blocked_by_route_quota")
        .when(~sparse & ~dense & anchored, "needs_anchor_rule")
        .when(~sparse & ~dense, "not_retrieved_sparse")
        .when(sparse & ~dense, "not_retrieved_dense")
        .when(dense & ~sparse, "not_retrieved_sparse")
        .otherwise("lost_in_merge")
    )


def best_branch(rows: DataFrame, branch: str) -> DataFrame:
    """The branch with the best recall, at 200 first, then 100, 50 and 10; among equals the name that sorts first."""
    order = Window.partitionBy("query_id").orderBy(*[F.desc(f"recall_at_{k}") for k in reversed(KS)], branch)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", F.col(branch).alias("best_branch"))


def nearest_rank_quantiles(rows: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """Q, threshold: the value at place ceil(q n) in order, for all levels in one aggregate; an empty table gives 1.0."""
    levels = ", ".join(map(str, qs))
    found = rows.agg(F.expr(f"percentile_disc(array({levels})) WITHIN GROUP (ORDER BY {value})").alias("t"))
    return found.select(F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), F.coalesce("t", F.array(*[F.lit(1.0) for _ in qs])).alias("threshold"))).alias("r")).select("r.*")


def nearest_rank_quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """B14 at one level."""
    return nearest_rank_quantiles(rows, value, [q])


def paragraph_keys(rows: DataFrame) -> DataFrame:
    """E5: citations as paragraph keys."""
    return rows.select("query_id", T.paragraph_key("citation").alias("citation")).where("citation <> ''").distinct()
