"""Queries over the corpus tables, reranking, evaluation, diagnostics, grids and mining."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import lexicons as L
from citeweave.functions import text as T
from citeweave.functions import understanding as U
from citeweave.operators import corpus as C
from citeweave.operators import evaluate as E
from citeweave.operators import fusion as FU
from citeweave.operators import grid as G
from citeweave.operators import mining as M
from citeweave.operators import rerank as RR
from citeweave.operators import sparse as SP
from citeweave.plans import retrieval_queries as RQ
from citeweave.plans import sql_text as S
from citeweave.plans.text_queries import query_views
from citeweave.runtime import table

BOOST_MODES = ("pattern_only", "pattern_plus_family", "pattern_plus_family_plus_overlap")
BRANCHES = ("dense_multi_view", "dense_source_aware", "sparse_bm25", "sparse_citation", "sparse_text", "sparse_title")


# ---- corpus ---------------------------------------------------------------------------------------------------------


def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    return C.citation_lookup(C.corpus(spark, d))


def source_map(spark: SparkSession, d: str) -> DataFrame:
    return C.source_map(C.corpus(spark, d))


def doc_lookup(spark: SparkSession, d: str) -> DataFrame:
    return C.doc_lookup(C.corpus(spark, d)).select("norm", "source", "row_id")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus_stats(C.corpus(spark, d))


def _norms(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus(spark, d).where("norm <> ''").select(F.col("norm").alias("citation")).distinct()


def gold_in_corpus(spark: SparkSession, d: str) -> DataFrame:
    return C.gold(spark, d).join(_norms(spark, d), "citation", "left_semi").select("query_id", "citation")


def gold_missing(spark: SparkSession, d: str) -> DataFrame:
    return C.gold(spark, d).join(_norms(spark, d), "citation", "left_anti").select("query_id", "citation")


def gold_canonical(spark: SparkSession, d: str) -> DataFrame:
    return C.resolve(C.gold(spark, d), citation_lookup(spark, d)).select("query_id", "citation").distinct()


# ---- evaluation -----------------------------------------------------------------------------------------------------


def _strict(spark: SparkSession, d: str) -> DataFrame:
    return E.per_query_f1(C.questions(spark, d), C.gold(spark, d), C.predictions(spark, d))


def _corpus_aware(spark: SparkSession, d: str) -> DataFrame:
    return E.per_query_f1(C.questions(spark, d), C.gold(spark, d), C.predictions(spark, d), citation_lookup(spark, d), corpus_aware=True)


def f1_strict(spark: SparkSession, d: str) -> DataFrame:
    return E.rounded(_strict(spark, d))


def f1_corpus_aware(spark: SparkSession, d: str) -> DataFrame:
    return E.rounded(_corpus_aware(spark, d))


def f1_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(_strict(spark, d), "strict").unionByName(E.summary(_corpus_aware(spark, d), "corpus_aware"))


def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    label = T.error_taxonomy(F.col("f1"), F.col("precision"), F.col("recall"), F.col("missing_gold"))
    return f1_corpus_aware(spark, d).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def paragraph_f1(spark: SparkSession, d: str) -> DataFrame:
    queries, gold, pred = C.questions(spark, d), C.gold(spark, d), C.predictions(spark, d)
    exact = E.per_query_f1(queries, gold, pred, empty=1.0).select("query_id", F.round("f1", 6).alias("exact_f1"))
    loose = E.per_query_f1(queries, E.paragraph_keys(gold), E.paragraph_keys(pred), empty=1.0).select("query_id", F.round("f1", 6).alias("paragraph_f1"))
    reachable = gold_in_corpus(spark, d).select("query_id").distinct().withColumn("r", F.lit(True))
    return exact.join(loose, "query_id").join(reachable, "query_id", "left").select("query_id", "exact_f1", "paragraph_f1", F.col("r").isNull().alias("unreachable"))


def lowest_f1(spark: SparkSession, d: str) -> DataFrame:
    """The twenty worst predicted queries (a top-k report)."""
    return f1_strict(spark, d).orderBy("f1", "query_id").limit(20).select("query_id", "f1")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return E.recall_rows(C.questions(spark, d), E.hit_ranks(gold_in_corpus(spark, d), C.candidates(spark, d)))


def recall_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Four things called recall at 200: macro over all gold, macro over gold in the corpus, micro, and the hit rate."""
    ranks = E.hit_ranks(C.gold(spark, d), C.candidates(spark, d)).join(_norms(spark, d).withColumn("known", F.lit(True)), "citation", "left")
    per = ranks.groupBy("query_id").agg(F.count_if(F.col("rank") <= 200).alias("h"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("known") & (F.col("rank") <= 200)).alias("hk"), F.count_if("known").alias("nk"))
    shares = {"macro_all_gold": F.avg(F.col("h") / F.col("n")), "macro_in_corpus": F.avg(F.when(F.col("nk") > 0, F.col("hk") / F.col("nk"))), "micro": F.sum("h") / F.sum("n"), "hit_rate": F.avg(F.when(F.col("h") > 0, 1.0).otherwise(0.0))}
    return per.agg(*[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for n, c in shares.items()])


def _branch_ranks(spark: SparkSession, d: str) -> DataFrame:
    return E.branch_hit_ranks(gold_in_corpus(spark, d), RQ.lists(spark, d), BRANCHES)


def branch_recall(spark: SparkSession, d: str) -> DataFrame:
    return E.recall_rows(C.questions(spark, d), _branch_ranks(spark, d), ["query_id", "list_id"])


def _gold_sources(spark: SparkSession, d: str) -> DataFrame:
    known = C.gold(spark, d).join(source_map(spark, d), "citation", "left")
    has = lambda s: F.coalesce(F.bool_or(F.col("source") == s), F.lit(False))
    kind = E.source_type(has("laws_de"), has("court_considerations"), F.bool_or(F.col("source").isNull()))
    return known.groupBy("query_id").agg(kind.alias("gold_source"), F.count("source").alias("gold_known"))


def gold_sources(spark: SparkSession, d: str) -> DataFrame:
    return _gold_sources(spark, d)


def branch_failures(spark: SparkSession, d: str) -> DataFrame:
    """E12, N37 for the laws and the court part of the text branch."""
    sources = _gold_sources(spark, d)
    parts = []
    for source in ("laws_de", "court_considerations"):
        mine = RQ.lists(spark, d).where((F.col("list_id") == "sparse_text") & (F.col("source") == source))
        ranks = E.hit_ranks(C.gold(spark, d), mine).groupBy("query_id").agg(F.coalesce(F.min("rank"), F.lit(-1)).alias("first_hit"), F.count_if(F.col("rank") <= 200).alias("at_200"))
        rows = sources.join(ranks, "query_id")
        parts.append(rows.select("query_id", F.lit(source).alias("branch"), E.failure_type(F.lit(source), F.col("gold_source"), F.col("gold_known"), F.lit(False), F.col("first_hit"), F.col("at_200")).alias("failure")))
    return parts[0].unionByName(parts[1])


def failure_clusters(spark: SparkSession, d: str) -> DataFrame:
    return branch_failures(spark, d).groupBy("branch", "failure").agg(F.count(F.lit(1)).alias("n"))


def best_branch(spark: SparkSession, d: str) -> DataFrame:
    return E.best_branch(branch_recall(spark, d), "list_id")


def branch_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall of every branch at every k, in long form."""
    means = branch_recall(spark, d).groupBy("list_id").agg(*[F.avg(f"recall_at_{k}").alias(f"r{k}") for k in E.KS])
    return means.unpivot("list_id", [f"r{k}" for k in E.KS], "metric", "value").withColumn("value", F.round("value", 6))


def config_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two configurations of the text branch by query, with the change of recall."""
    rows = branch_recall(spark, d)
    a = rows.where("list_id = 'sparse_bm25'").select("query_id", F.col("recall_at_50").alias("a_50"), F.col("recall_at_200").alias("a_200"))
    b = rows.where("list_id = 'sparse_text'").select("query_id", F.col("recall_at_50").alias("b_50"), F.col("recall_at_200").alias("b_200"))
    return a.join(b, "query_id").select("query_id", "a_50", "b_50", F.round(F.col("b_50") - F.col("a_50"), 6).alias("delta_50"), F.round(F.col("b_200") - F.col("a_200"), 6).alias("delta_200"))


# ---- rerank and selection -------------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The first fused candidates of every query with their text and the evidence for them."""
    lists = RQ.lists(spark, d)
    fused = FU.reciprocal_rank(lists, k).select("query_id", "citation", F.col("score").alias("fused_score"), F.col("rank").alias("fused_rank"))
    flags = lists.groupBy("query_id", "citation").agg(
        F.max((F.col("list_id") == "rule_exact").cast("int")).alias("is_rule"), F.max((F.col("list_id") == "sparse_title").cast("int")).alias("is_issue"),
        F.max((F.col("list_id") == "sparse_text").cast("int")).alias("s"), F.max((F.col("list_id") == "dense_multi_view").cast("int")).alias("v"), F.min("source").alias("hit_source"),
    )
    docs = C.doc_lookup(C.corpus(spark, d)).select(F.col("norm").alias("citation"), "source", "title", "text")
    queries = C.questions(spark, d).select("query_id", "query", U.likely_families("query").alias("families"), (F.size(T.rule_patterns("query")) > 0).alias("explicit"))
    rows = fused.join(flags, ["query_id", "citation"]).join(docs, "citation", "left").join(queries, "query_id")
    rows = rows.withColumn("source", F.coalesce("source", "hit_source")).withColumn("body", T.joined(F.col("citation"), F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    both, dense_only = F.col("s") * F.col("v"), F.when((F.col("v") == 1) & (F.col("s") + F.col("is_rule") + F.col("is_issue") == 0), 1).otherwise(0)
    family = F.coalesce(FU.family_match(), F.lit(False)).cast("int")
    return rows.select("query_id", "query", "citation", "source", "body", "fused_score", "fused_rank", "is_rule", "is_issue", both.alias("is_both"), dense_only.alias("is_dense_only"), family.alias("is_family"), "explicit")


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    return RR.rerank(_candidates(spark, d), RR.token_overlap, 320)


def token_overlap_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("query_id", "citation", "rerank_score", "rerank_rank")


def evidence_calibration(spark: SparkSession, d: str) -> DataFrame:
    return RR.calibrate(_reranked(spark, d), 20).select("query_id", "citation", "calibrated_score", "calibrated_rank")


def cut_fixed(spark: SparkSession, d: str) -> DataFrame:
    return RR.cut(_reranked(spark, d), "fixed", 5).select("query_id", "citation", "rerank_rank")


def cut_score(spark: SparkSession, d: str) -> DataFrame:
    return RR.cut(_reranked(spark, d), "score", 5, threshold=0.15).select("query_id", "citation", "rerank_rank")


def cut_relative(spark: SparkSession, d: str) -> DataFrame:
    return RR.cut(_reranked(spark, d), "relative", 5, relative=0.85).select("query_id", "citation", "rerank_rank")


def final_rescue(spark: SparkSession, d: str) -> DataFrame:
    return RR.rescue(_candidates(spark, d), cut_fixed(spark, d), 1).select("query_id", "citation", "fused_rank")


def final_union(spark: SparkSession, d: str) -> DataFrame:
    """Rule hits, then the cut, then the rescued."""
    rules = RQ.lists(spark, d).where("list_id = 'rule_exact' AND source = 'laws_de'").select("query_id", "citation", "rank")
    return RR.ordered_union(rules, cut_fixed(spark, d).withColumnRenamed("rerank_rank", "rank"), final_rescue(spark, d).withColumnRenamed("fused_rank", "rank"))


def rerank_shaping(spark: SparkSession, d: str) -> DataFrame:
    pool = _candidates(spark, d).withColumn("is_laws", (F.col("source") == "laws_de").cast("int")).withColumn("pool_score", F.col("fused_score"))
    return RR.shape_input(pool, 30, 15).select("query_id", "citation", "tier", "input_rank")


def admission_audit(spark: SparkSession, d: str) -> DataFrame:
    """Where each gold citation was lost."""
    reranked = _reranked(spark, d).select("query_id", "citation", "fused_rank", F.col("rerank_rank").alias("after"), "is_rule", "is_issue", "is_family")
    final = C.predictions(spark, d).select("query_id", "citation").withColumn("in_final", F.lit(True))
    rows = C.gold(spark, d).join(reranked, ["query_id", "citation"], "left").join(final, ["query_id", "citation"], "left")
    stage = E.drop_stage(F.col("in_final").isNotNull(), F.col("fused_rank"), F.col("after").isNotNull(), F.col("after"), 5)
    return rows.select("query_id", "citation", F.coalesce("fused_rank", F.lit(-1)).alias("fused_rank"), F.coalesce("after", F.lit(-1)).alias("rank_after"), stage.alias("drop_stage"))


def subset_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics over all queries and by whether a query is explicit, in one pass by grouping sets."""
    explicit = C.questions(spark, d).select("query_id", (F.size(T.rule_patterns("query")) > 0).alias("explicit"))
    rows = _strict(spark, d).join(explicit, "query_id")
    cube = rows.rollup("explicit").agg(F.grouping("explicit").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.sum("fp").alias("fp"))
    return cube.select(F.when(F.col("g") == 1, "all").when(F.col("explicit"), "explicit").otherwise("other").alias("subset"), "n", "macro_f1", "fp")


def miss_reason(spark: SparkSession, d: str) -> DataFrame:
    lists = RQ.lists(spark, d)
    found = C.gold(spark, d).join(lists.select("query_id", "citation", "list_id"), ["query_id", "citation"])
    branch = found.groupBy("query_id").agg(F.bool_or(F.startswith("list_id", F.lit("sparse"))).alias("sparse"), F.bool_or(F.startswith("list_id", F.lit("dense"))).alias("dense"))
    ranks = E.hit_ranks(C.gold(spark, d), C.candidates(spark, d)).groupBy("query_id").agg(F.coalesce(F.bool_or(F.col("rank") <= 200), F.lit(False)).alias("hit"))
    pool = C.candidates(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("pool"))
    quota = query_views(spark, d).select("query_id", "query", U.quotas(U.route(U.routed_text("query", "numbers"))["route"]).alias("q"))
    rows = ranks.join(branch, "query_id", "left").join(pool, "query_id", "left").join(quota, "query_id")
    anchored = F.contains("query", F.lit("Art.")) | F.contains("query", F.lit("BGE")) | F.contains("query", F.lit("_"))
    reason = E.miss_reason(F.col("hit"), F.coalesce("pool", F.lit(0)), F.col("q.laws_sparse") + F.col("q.court_sparse"), F.coalesce("sparse", F.lit(False)), F.coalesce("dense", F.lit(False)), anchored)
    return rows.select("query_id", reason.alias("reason"))


def reason_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Reasons by gold source; every source has rows, those without a query too."""
    domain = spark.createDataFrame([(s,) for s in ("laws_only", "court_only", "mixed", "unknown")], "gold_source string")
    rows = miss_reason(spark, d).join(_gold_sources(spark, d), "query_id").groupBy("gold_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "hit_in_fused_top200").alias("hits"))
    return domain.join(rows, "gold_source", "left").fillna(0)


def tail_rescues(spark: SparkSession, d: str) -> DataFrame:
    """Gold that the text branch ranks from 101 to 200."""
    ranks = _branch_ranks(spark, d).where("list_id = 'sparse_text'")
    return ranks.groupBy("query_id").agg(F.count_if(F.col("rank").between(101, 200)).alias("n_tail"))


def truncation_audit(spark: SparkSession, d: str) -> DataFrame:
    """How far into its text a gold law first shows a word of its query."""
    words = query_views(spark, d).select("query_id", F.filter("words", lambda w: F.length(w) >= 4).alias("words"))
    docs = C.doc_lookup(C.corpus(spark, d)).where("source = 'laws_de'").select(F.col("norm").alias("citation"), F.lower("text").alias("text"))
    rows = C.gold(spark, d).join(docs, "citation").join(words, "query_id")
    places = F.filter(F.transform("words", lambda w: F.position(w, F.col("text"))), lambda p: p > 0)
    first = F.array_min(places)
    bucket = F.when(first.isNull(), "no_detectable_query_signal").when(first <= 500, "within_500").when(first <= 900, "within_900").otherwise("beyond_900")
    return rows.select("query_id", "citation", F.length("text").alias("n_chars"), bucket.alias("bucket"))


def routing_counts(spark: SparkSession, d: str) -> DataFrame:
    """E29."""
    rows = query_views(spark, d).select(U.route(U.routed_text("query", "numbers")).alias("r")).select("r.*")
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("case_signals"), 6).alias("case_signals"), F.count_if(F.col("confidence") == "high").alias("n_high"))


def route_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How the recorded routes of the traces agree with the sources of the gold."""
    recorded = table(spark, d, "val_seed_trace_silver_baseline_v0").where("query_id IS NOT NULL").groupBy("query_id").agg(F.max_by("route_label", "row_id").alias("route"))
    wanted = F.when(F.col("gold_source") == "laws_only", "laws").when(F.col("gold_source") == "court_only", "court").otherwise("hybrid")
    rows = recorded.join(_gold_sources(spark, d), "query_id", "left").withColumn("wanted", F.when(F.col("gold_source").isNull(), "hybrid").otherwise(wanted))
    return rows.groupBy("wanted").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("route") == F.col("wanted")).alias("agree"), F.count_if((F.col("route") == "hybrid") & (F.col("wanted") != "hybrid")).alias("over_routed"))


def preflight(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each prediction of the submission."""
    rows = table(spark, d, "submission_baseline_v1").where("query_id IS NOT NULL").select("query_id", T.split_citations("predicted_citations").alias("p"))
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(F.size("p") == 0).alias("has_empty"), F.bool_or(F.size("p") != F.size(F.array_distinct("p"))).alias("has_repeats"))


# ---- grids and mining -----------------------------------------------------------------------------------------------


def _raw_fields(spark: SparkSession, d: str) -> DataFrame:
    """Raw scores by field from the recorded hits of the field branches."""
    rows = C.hits(spark, d).where("list_id IN ('sparse_citation', 'sparse_title', 'sparse_text')")
    return rows.select("query_id", "source", "citation", F.regexp_replace("list_id", "sparse_", "").alias("field"), "score")


def _weights(spark: SparkSession) -> DataFrame:
    return G.configs(spark, w_citation=[1.0, 1.5, 2.0, 3.0], w_title=[0.5, 1.0, 1.5, 2.0], w_text=[0.5, 1.0, 1.5, 2.0])


def weight_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = _weights(spark)
    return G.grid_recall(C.gold(spark, d), G.ranked(G.weigh(G.components(_raw_fields(spark, d)), grid), 200), grid, (100, 200))


def weight_grid_best(spark: SparkSession, d: str) -> DataFrame:
    return G.best_config(weight_grid(spark, d), ["recall_at_100", "recall_at_200"])


def _title_shares(spark: SparkSession, d: str) -> DataFrame:
    laws = C.corpus(spark, d, court_rows=0).where("norm <> ''")
    by_template = laws.groupBy(T.title_template("title").alias("template")).agg(F.count(F.lit(1)).alias("n"))
    shares = by_template.crossJoin(F.broadcast(by_template.agg(F.sum("n").alias("total")))).select("template", (F.col("n") / F.col("total")).alias("df_share"))
    titled = laws.groupBy(F.col("norm").alias("citation")).agg(F.max_by(T.title_template("title"), "row_id").alias("template"))
    return titled.join(shares, "template").select("citation", "df_share")


def title_df_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Shares above which titles are common, at four levels."""
    return E.nearest_rank_quantiles(_title_shares(spark, d), "df_share", [0.90, 0.95, 0.97, 0.99]).select("q", F.round("threshold", 6).alias("threshold"))


def penalty_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall and triggered penalties by mode and strength."""
    grid = G.configs(spark, mode=["df_only", "df_plus_dominance"], strength=[0.3, 0.6]).withColumns({"w_citation": F.lit(2.0), "w_title": F.lit(2.0), "w_text": F.lit(1.0), "df_threshold": F.lit(0.01), "dominance": F.lit(0.5), "low_citation": F.lit(0.3)})
    parts = G.components(_raw_fields(spark, d)).join(_title_shares(spark, d), "citation", "left").fillna(0.0, subset=["df_share"])
    rows = G.title_penalty(G.weigh(parts, grid))
    triggered = rows.groupBy("config_id").agg(F.count_if("triggered").alias("n_triggered"))
    return G.grid_recall(C.gold(spark, d), G.ranked(rows, 200), grid, (100, 200)).join(triggered, "config_id", "left").fillna(0)


def citation_boost_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall of no boost (config 0) and of the 108 configs of mode and strengths.

    A mode leaves out the boosts it does not name; configs that come to the same boosts are computed once.
    """
    same: dict[tuple[float, float, float], int] = {(0.0, 0.0, 0.0): 0}
    configs = [(0, 0)]
    for i, (mode, pattern, family, overlap) in enumerate(product(BOOST_MODES, (0.05, 0.1, 0.15, 0.2), (0.05, 0.1, 0.15), (0.05, 0.1, 0.15)), 1):
        boosts = (pattern, family if mode != "pattern_only" else 0.0, overlap if mode == "pattern_plus_family_plus_overlap" else 0.0)
        configs.append((i, same.setdefault(boosts, len(same))))
    grid = spark.createDataFrame([(i, *boosts) for boosts, i in same.items()], "config_id long, b_pattern double, b_family double, b_overlap double").withColumns({"w_citation": F.lit(2.0), "w_title": F.lit(2.0), "w_text": F.lit(1.0)})
    views = query_views(spark, d).select("query_id", "numbers", T.citation_tokens("query").alias("q_tokens")).withColumn("q_families", F.filter("q_tokens", lambda t: t.isin(*L.FAMILIES_LAST)))
    parts = G.components(_raw_fields(spark, d)).join(views, "query_id")
    rows = G.citation_boost(G.weigh(parts, grid), F.col("numbers"), F.col("q_families"), F.col("q_tokens"))
    results = G.grid_recall(C.gold(spark, d), G.ranked(rows, 200), grid, (100, 200)).withColumnRenamed("config_id", "same")
    return F.broadcast(spark.createDataFrame(configs, "config_id long, same long")).join(results, "same").drop("same")


def fp_profile(spark: SparkSession, d: str) -> DataFrame:
    """For gold that ranks beyond 100 or nowhere, the twenty best rivals and what lifts them (a top-k report)."""
    grid = G.configs(spark, w_citation=[2.0], w_title=[2.0], w_text=[1.0])
    weighed = G.weigh(G.components(_raw_fields(spark, d)), grid)
    ranked = G.ranked(weighed, 200).where("source = 'laws_de'")
    gold = C.gold(spark, d)
    lost = gold.join(ranked.select("query_id", "citation", F.col("rank").alias("gold_rank"), *[F.col(a).alias(f"g_{a}") for a in "ctx"]), ["query_id", "citation"], "left")
    lost = lost.where("gold_rank IS NULL OR gold_rank > 100").withColumnRenamed("citation", "gold_citation").fillna(0.0, subset=["g_c", "g_t", "g_x"])
    rivals = SP.top_k(ranked.drop("rank").join(gold, ["query_id", "citation"], "left_anti"), ["query_id"], [F.desc("score"), F.asc("citation")], 20)
    rows = rivals.join(lost, "query_id")
    why = G.why_it_wins({a: F.col(a) for a in "ctx"}, {a: F.col(f"g_{a}") for a in "ctx"})
    return rows.select("query_id", "gold_citation", F.col("citation").alias("fp_citation"), F.col("rank").alias("fp_rank"), F.coalesce("gold_rank", F.lit(-1)).alias("gold_rank"), why.alias("why"))


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2: one positive and one hard negative law for every query with gold laws."""
    docs = C.doc_lookup(C.corpus(spark, d)).where("source = 'laws_de'").select(F.col("norm").alias("citation"), F.lower("text").alias("text"))
    fused = FU.reciprocal_rank(RQ.lists(spark, d), 20)
    return M.hard_negatives(query_views(spark, d), C.gold(spark, d), fused.select("query_id", "citation", "rank"), docs)


QUERIES = {
    f.__name__: f
    for f in (
        citation_lookup, source_map, doc_lookup, corpus_stats, gold_in_corpus, gold_missing, gold_canonical, f1_strict, f1_corpus_aware, f1_summary, error_taxonomy, paragraph_f1, lowest_f1,
        recall_at_k, recall_definitions, branch_recall, gold_sources, branch_failures, failure_clusters, best_branch, branch_means, config_compare, token_overlap_rerank, evidence_calibration,
        cut_fixed, cut_score, cut_relative, final_rescue, final_union, rerank_shaping, admission_audit, subset_metrics, miss_reason, reason_by_source, tail_rescues, truncation_audit, routing_counts,
        route_agreement, preflight, weight_grid, weight_grid_best, title_df_quantile, penalty_grid, citation_boost_grid, fp_profile, hard_negatives,
    )
}
