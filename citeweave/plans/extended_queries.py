"""Queries over the failure cascade, seeds, three-way fusion, plain extraction, dense text views, negatives and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import lexicons as L
from citeweave.functions import text as T
from citeweave.functions import understanding as U
from citeweave.operators import corpus as C
from citeweave.operators import dense as D
from citeweave.operators import evaluate as E
from citeweave.operators import fusion as FU
from citeweave.operators import grid as G
from citeweave.operators import mining as M
from citeweave.operators import rerank as RR
from citeweave.operators import rules as R
from citeweave.operators import sparse as SP
from citeweave.plans import evaluation_queries as EQ
from citeweave.plans import evaluation_sql as ES
from citeweave.plans import retrieval_queries as RQ
from citeweave.plans import sql_text as S
from citeweave.plans.text_queries import query_views
from citeweave.runtime import cut_lineage

# ---- failure cascade and seeds --------------------------------------------------------------------------------------


def _source_lists(spark: SparkSession, d: str) -> DataFrame:
    """The sparse and the dense list by source, each ranked by itself: query_id, kind, source, citation, rank, laws_rank."""
    rows = C.hits(spark, d).where("list_id IN ('sparse_bm25', 'dense_multi_view')").withColumn("kind", F.regexp_extract("list_id", "^[a-z]+", 0))
    whole = FU.rank_whole(rows)
    by_source = FU.rank_whole(rows.withColumn("list_id", F.concat("kind", F.lit("_"), "source"))).select("query_id", "kind", "source", "citation", F.col("rank").alias("laws_rank"))
    return whole.join(by_source, ["query_id", "kind", "source", "citation"]).select("query_id", "kind", "source", "citation", "rank", "laws_rank")


def _branches(lists: DataFrame, hits: DataFrame, fused: DataFrame) -> DataFrame:
    """query_id, branch, citation, rank of the two lists by source, the rules and the fused list."""
    side = F.when(F.col("source") == "laws_de", "laws").otherwise("court")
    parts = lists.select("query_id", F.concat_ws("_", "kind", side).alias("branch"), "citation", F.col("laws_rank").alias("rank"))
    rules = hits.where("list_id IN ('rule_exact', 'rule_prefix')").groupBy("query_id", "citation").agg(F.max("score").alias("score")).withColumn("list_id", F.lit("rule")).withColumn("source", F.lit(""))
    rules = FU.rank_whole(rules).select("query_id", F.lit("rule").alias("branch"), "citation", "rank")
    return parts.unionByName(rules).unionByName(fused.select("query_id", F.lit("fusion_final").alias("branch"), "citation", "rank"))


BRANCHES = ("sparse_laws", "sparse_court", "dense_laws", "dense_court", "rule", "fusion_final")


def failure_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The failure of every query in every branch, with the rank of the first gold."""
    hits, rows = C.hits(spark, d), C.corpus(spark, d)
    fused = cut_lineage(FU.reciprocal_rank(RQ.lists(spark, d), 320).select("query_id", "citation", "rank"))
    branches = _branches(_source_lists(spark, d), hits, fused).groupBy("query_id", "branch", "citation").agg(F.min("rank").alias("rank"))
    sources = C.source_map(rows)
    raw = C.questions(spark, d).select("query_id", "query", F.explode_outer(F.filter(F.transform(F.split(F.coalesce("gold", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")).alias("raw"))
    raw = raw.withColumn("citation", T.normalize_citation("raw"))
    raw = raw.join(sources.select(F.col("citation").alias("raw"), F.lit(True).alias("stands")), "raw", "left").join(sources.select("citation", F.lit(True).alias("folded")), "citation", "left")
    of_query = raw.groupBy("query_id").agg(
        F.any_value("query").alias("query"), F.coalesce(F.bool_or(F.rlike("raw", F.lit(L.GOLD_PATTERN))), F.lit(False)).alias("patterned"),
        F.coalesce(F.bool_or(F.col("stands").isNull() & F.col("folded").isNotNull()), F.lit(False)).alias("mismatch"),
    )
    rules = branches.where("branch = 'rule'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rules"))
    known = EQ.gold_in_corpus(spark, d)
    kinds = known.join(sources, "citation").groupBy("query_id").agg(E.source_type(F.bool_or(F.col("source") == "laws_de"), F.bool_or(F.col("source") == "court_considerations"), F.lit(False)).alias("sources"))
    final = C.predictions(spark, d)
    member = lambda rows, name: known.join(rows.select("query_id", "citation").distinct(), ["query_id", "citation"]).select("query_id").distinct().withColumn(name, F.lit(True))
    facts = of_query.join(rules, "query_id", "left").join(kinds, "query_id", "left").join(member(hits, "in_union"), "query_id", "left").join(member(fused, "in_fusion"), "query_id", "left").join(member(final, "in_final"), "query_id", "left")
    wanted = known.withColumn("branch", F.explode(F.array(*[F.lit(b) for b in BRANCHES])))
    ranks = wanted.join(branches, ["query_id", "branch", "citation"], "left").groupBy("query_id", "branch").agg(F.count(F.lit(1)).alias("n_known"), F.coalesce(F.min("rank"), F.lit(-1)).alias("first_hit"), F.count_if(F.col("rank") <= 200).alias("at_200"))
    out = facts.withColumn("branch", F.explode(F.array(*[F.lit(b) for b in BRANCHES]))).join(ranks, ["query_id", "branch"], "left").fillna({"n_known": 0, "first_hit": -1, "at_200": 0, "n_rules": 0})
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    label = E.failure_cascade(
        F.col("branch"), F.col("n_known"), F.col("first_hit"), F.col("at_200"), T.language_gap("query"), F.col("patterned") & (F.col("n_rules") == 0), F.col("mismatch"), F.coalesce("sources", F.lit("unknown")),
        flag("in_union"), flag("in_fusion"), flag("in_final"),
    )
    return out.select("query_id", "branch", F.col("n_known").cast("long").alias("n_known"), F.col("first_hit").cast("int").alias("first_hit"), label.alias("failure"))


def _court_rank(lists: DataFrame) -> DataFrame:
    court = lists.where("source = 'court_considerations'").select("query_id", "kind", "citation", F.col("laws_rank").alias("rank"))
    return FU.court_fusion(court.where("kind = 'sparse'").drop("kind"), court.where("kind = 'dense'").drop("kind"), 1.5, 220)


def three_way_fusion(spark: SparkSession, d: str) -> DataFrame:
    """F14 over the recorded lists."""
    lists = cut_lineage(_source_lists(spark, d))
    return FU.three_way(lists.where("kind = 'sparse'"), lists.where("kind = 'dense'"), _court_rank(lists))


def seed_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    """For every query with gold, which lists hold gold and how early, and why the fused list has none."""
    lists = cut_lineage(_source_lists(spark, d))
    gold, court = C.gold(spark, d), _court_rank(lists)
    fused = C.candidates(spark, d).where("rank <= 200")
    rows = lists.groupBy("query_id", "kind", "citation").agg(F.min("rank").alias("rank"), F.bool_or(F.col("source") == "laws_de").alias("laws"), F.bool_or(F.col("source") != "laws_de").alias("court"))
    met = gold.join(rows, ["query_id", "citation"])
    flags = met.groupBy("query_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col(s).cast("int"))).alias(f"{k}_{s}") for k in ("sparse", "dense") for s in ("laws", "court")], *[F.min(F.when(F.col("kind") == k, F.col("rank"))).alias(f"best_{k}") for k in ("sparse", "dense")]
    )
    best = lambda ranked, name: gold.join(ranked, ["query_id", "citation"]).groupBy("query_id").agg(F.min("rank").alias(name))
    size = lambda rows, name: rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    out = gold.select("query_id").distinct()
    for more in (flags, best(court, "best_court_rank"), best(fused, "best_fused"), size(fused, "pool"), size(court, "n_court_rank"), size(lists.where("kind = 'dense' AND source <> 'laws_de'"), "n_dense_court")):
        out = out.join(more, "query_id", "left")
    views = query_views(spark, d).select("query_id", "query", U.route(U.routed_text("query", "numbers"))["route"].alias("route"))
    out = out.join(views.withColumn("q", U.quotas("route")), "query_id").fillna(0, ["sparse_laws", "sparse_court", "dense_laws", "dense_court", "pool", "n_court_rank", "n_dense_court"]).fillna(-1, ["best_sparse", "best_dense", "best_court_rank", "best_fused"])
    anchored = F.contains("query", F.lit(L.ANCHORS[0])) | F.contains("query", F.lit(L.ANCHORS[1])) | F.contains("query", F.lit(L.ANCHORS[2]))
    total = F.col("q.laws_sparse") + F.col("q.court_sparse") + F.col("q.laws_dense") + F.col("q.court_dense")
    reason = E.seed_miss_reason(
        F.col("best_fused") > 0, F.col("pool"), F.col("q.court_dense") > 0, F.col("n_dense_court") > 0, total, F.col("sparse_laws") + F.col("sparse_court") > 0, F.col("dense_laws") + F.col("dense_court") > 0, anchored, F.col("n_court_rank") == 0
    )
    mode = F.when(F.col("n_court_rank") > 0, "court_dense_threeway_rrf").otherwise("fallback_full_rrf_due_empty_court_rank")
    return out.select("query_id", "route", mode.alias("fusion_mode"), "sparse_laws", "sparse_court", "dense_laws", "dense_court", *[F.col(c).cast("int").alias(c) for c in ("best_sparse", "best_dense", "best_court_rank", "best_fused")], F.col("pool").cast("long").alias("pool"), reason.alias("miss_reason"))


def miss_reason_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = seed_effectiveness(spark, d).groupBy("miss_reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def route_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Every route by every kind of gold, empty groups too: how often gold is in the fused list, and the fusion modes."""
    rows = seed_effectiveness(spark, d).join(EQ.gold_sources(spark, d), "query_id")
    domain = rows.select("route").distinct().withColumn("gold_source", F.explode(F.array(*[F.lit(s) for s in ("laws_only", "court_only", "mixed", "unknown")])))
    modes = rows.groupBy("route", "gold_source", "fusion_mode").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("best_fused") > 0).alias("h"), F.sum("sparse_court").alias("sc"), F.sum("dense_court").alias("dc"))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fusion_mode", "m"))), lambda x: F.concat_ws(":", x["fusion_mode"], x["m"].cast("string"))), ";")
    rates = modes.groupBy("route", "gold_source").agg(F.sum("m").alias("n"), *[F.round(F.sum(c) / F.sum("m"), 6).alias(a) for c, a in (("h", "recall_at_200"), ("sc", "sparse_court_rate"), ("dc", "dense_court_rate"))], named.alias("modes"))
    return domain.join(rates, ["route", "gold_source"], "left").fillna(0, ["n"]).fillna(0.0, ["recall_at_200", "sparse_court_rate", "dense_court_rate"]).fillna("", ["modes"])


# ---- rerank rules and probes ----------------------------------------------------------------------------------------

DEFAULT_CITATION = "Art. 1 ZGB"


def notebook_cuts(spark: SparkSession, d: str) -> DataFrame:
    """The three cuts over scores around zero, with the default citation for queries that keep nothing."""
    rows = cut_lineage(EQ._reranked(spark, d).withColumn("rerank_score", F.round(F.col("rerank_score") - 0.2, 6)).select("query_id", "citation", "rerank_score", "rerank_rank"))
    queries, out = C.questions(spark, d), None
    for mode in ("positive", "top", "adaptive"):
        part = RR.fill_empty(queries, RR.cut_logits(rows, mode), DEFAULT_CITATION).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def _probes() -> list[tuple[str, str]]:
    """One question for every issue rule: the cues of its family and its own, as they stand in the lexicon."""
    out = []
    for family, group in L.ISSUE_RULES.items():
        cues = " ".join(c for c, w in L.FAMILY_CUES[family] if w > 0)
        out += [(f"{family}:{name}", f"{cues} {' '.join(own)}") for name, own, _ in group]
    return out


def _probe_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_probes(), "query_id string, query string")


def issue_groups_probe(spark: SparkSession, d: str) -> DataFrame:
    """N23 for a question that names each issue."""
    rows = _probe_questions(spark).select("query_id", F.posexplode(U.issue_groups("query", U.likely_families("query"))).alias("rank", "name"))
    return rows.withColumn("rank", F.col("rank") + 1)


def issue_terms_probe(spark: SparkSession, d: str) -> DataFrame:
    """N24 for a question that names each issue."""
    groups = _probe_questions(spark).select("query_id", U.issue_groups("query", U.likely_families("query")).alias("groups"))
    return groups.select("query_id", F.posexplode(U.issue_terms("groups")).alias("pos", "term"))


def training_queries_probe(spark: SparkSession, d: str) -> DataFrame:
    """M5 for a question that names each issue: its words, family terms and issue terms as a trainer gets them."""
    return M.training_query(_probe_questions(spark).withColumn("clean", T.clean_query("query"))).select("query_id", F.length("text").alias("n_chars"), F.size(T.tokens("text")).alias("n_words"))


def error_taxonomy_at_k(spark: SparkSession, d: str) -> DataFrame:
    """N35 for the first k candidates as predictions: all labels occur between k = 1 and k = 200."""
    lookup, out = EQ.citation_lookup(spark, d), None
    ranked = C.candidates(spark, d)
    for k in (1, 3, 5, 20, 200):
        rows = E.rounded(E.per_query_f1(C.questions(spark, d), C.gold(spark, d), ranked.where(F.col("rank") <= k), lookup, corpus_aware=True))
        part = rows.groupBy(T.error_taxonomy(F.col("f1"), F.col("precision"), F.col("recall"), F.col("missing_gold")).alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def final_rescue_probe(spark: SparkSession, d: str) -> DataFrame:
    """R9 with the families of the gold laws as the predicted ones, for every query."""
    families = C.gold(spark, d).select("query_id", T.family_first("citation").alias("family")).where("family <> ''").distinct().withColumn("wanted", F.lit(1))
    rows = EQ._candidates(spark, d).drop("is_family", "explicit").withColumn("family", T.family_first("citation")).join(families, ["query_id", "family"], "left")
    rows = cut_lineage(rows.select("query_id", "citation", "source", "fused_score", "fused_rank", F.coalesce("wanted", F.lit(0)).alias("is_family"), F.lit(False).alias("explicit")))
    first = rows.where("fused_rank <= 5")
    return RR.rescue(rows, first, 2).select("query_id", "citation", "fused_rank")


def explicit_families(spark: SparkSession, d: str) -> DataFrame:
    """N20 over the evaluation questions and the citations that people type."""
    rows = C.questions(spark, d).select("query_id", F.concat_ws(" ", "query", "gold").alias("t"))
    return rows.select("query_id", F.posexplode(T.explicit_families("t")).alias("pos", "family"))


# ---- plain extraction -----------------------------------------------------------------------------------------------


def plain_citations(spark: SparkSession, d: str) -> DataFrame:
    """N47 over the texts of the decisions."""
    rows = C.corpus(spark, d, laws_rows=0)
    return rows.select("row_id", F.explode(T.plain_citations("text")).alias("citation"))


def numbered_laws(spark: SparkSession, d: str) -> DataFrame:
    """Citations with the numbers of their laws."""
    return C.corpus(spark, d).select("source", "row_id", T.numbered_law("citation").alias("numbered"))


def extraction_recall(spark: SparkSession, d: str) -> DataFrame:
    """Micro recall of plain extraction from the question and the field typed beside it, over all gold values."""
    rows = C.questions(spark, d).select(T.plain_citations(F.concat_ws(" ", "query", "gold")).alias("found"), F.array_distinct(F.filter(F.split(F.coalesce("gold", F.lit("")), ";"), lambda x: x != "")).alias("gold"))
    counts = rows.agg(F.sum(F.size("gold")).alias("n_gold"), F.sum(F.size("found")).alias("n_extracted"), F.sum(F.size(F.array_intersect("gold", "found"))).alias("n_hits"))
    return counts.select(*[F.col(c).cast("long").alias(c) for c in ("n_gold", "n_extracted", "n_hits")], F.round(F.coalesce(F.col("n_hits") / F.nullif(F.col("n_gold"), F.lit(0)), F.lit(0.0)), 6).alias("recall"))


def contained_citations(spark: SparkSession, d: str) -> DataFrame:
    """The citations of the corpus that hold an article extracted from a typed gold field."""
    patterns = C.questions(spark, d).select(F.explode(T.plain_citations("gold")).alias("pattern")).distinct()
    docs = C.corpus(spark, d).where("citation <> ''").select("source", F.col("citation").alias("norm")).distinct()
    return R.contained(patterns, docs).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("first"))


def bm25_okapi(spark: SparkSession, d: str) -> DataFrame:
    """The three best laws for every evaluation item in German."""
    laws = C.corpus(spark, d, court_rows=0)
    items = EQ.table(spark, d, "eval_items")
    return SP.okapi(laws, F.col("text"), "row_id", items, "item_id", F.col("text"), 3)


# ---- dense text views -----------------------------------------------------------------------------------------------

DIMS = 64


def _text_views(spark: SparkSession, d: str) -> DataFrame:
    """The four views of the stated questions with their boosts: as asked, cleaned, German, phrases."""
    v = cut_lineage(query_views(spark, d).where("row_id % 100 = 0"))
    german = U.german_view(U.german_keywords("clean", L.GENERAL_EN_DE), L.GENERAL_SNIPPETS, "numbers")
    parts = [("original", 1.0, F.col("query")), ("clean", 0.9, F.col("clean")), ("german", 0.9, german), ("phrases", 0.9, F.array_join("phrases", " "))]
    views = v.select("query_id", F.posexplode(F.array(*[F.struct(F.lit(n).alias("view"), F.lit(b).alias("boost"), t.alias("text")) for n, b, t in parts])).alias("place", "v"))
    return views.select(F.xxhash64("query_id", "place").alias("view_id"), "query_id", "v.view", "v.boost", "v.text").where("trim(text) <> ''")


def _dense_views(spark: SparkSession, d: str, corpus: DataFrame, k: int) -> DataFrame:
    """Corpus and views under one transform; the best boosted score of a row counts."""
    # Understood once; every later reader would plan and evaluate the whole of it again.
    views = cut_lineage(_text_views(spark, d))
    rows = corpus.where("norm <> ''").select("source", "row_id", T.joined(F.col("norm"), F.col("title"), F.col("text")).alias("body"))
    vectors = D.encode(rows, "body", D.hashed_encoder(DIMS)).select("source", F.col("row_id").alias("id"), "embedding")
    queries = D.encode(views, "text", D.hashed_encoder(DIMS)).select(F.col("view_id").alias("query_id"), "embedding")
    scores = D.dense_scores(vectors, queries, k).withColumnRenamed("query_id", "view_id").join(F.broadcast(views.select("view_id", "query_id", "boost")), "view_id")
    best = scores.groupBy("query_id", "source", "id").agg(F.round(F.max(F.col("score") * F.col("boost")), 6).alias("score"))
    return SP.top_k(best, ["query_id", "source"], [F.desc("score"), F.asc("id")], k)


def dense_text_views(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best rows of each source by four views of the stated questions."""
    return _dense_views(spark, d, C.corpus(spark, d), 20)


def dense_court_views(spark: SparkSession, d: str) -> DataFrame:
    """The same over the decisions only."""
    return _dense_views(spark, d, C.corpus(spark, d, laws_rows=0), 20)


# ---- negatives and grids --------------------------------------------------------------------------------------------


def _negatives(spark: SparkSession, d: str, prefer_family: bool) -> DataFrame:
    laws = C.first_rows(C.corpus(spark, d, court_rows=0)).select(F.col("norm").alias("citation"))
    return M.family_negatives(C.gold(spark, d), FU.reciprocal_rank(RQ.lists(spark, d), 200).select("query_id", "citation", "rank"), laws, prefer_family)


def negatives_family(spark: SparkSession, d: str) -> DataFrame:
    """M1 (b): the best ranked wrong law of the gold's family, if there is one."""
    return _negatives(spark, d, True)


def negatives_first(spark: SparkSession, d: str) -> DataFrame:
    """M1 (c): the best ranked wrong law."""
    return _negatives(spark, d, False)


def negatives_dense(spark: SparkSession, d: str) -> DataFrame:
    """M3: the first wrong one of the fifteen best dense hits."""
    dense = RQ.lists(spark, d).where("list_id = 'dense_multi_view'").groupBy("query_id", "citation").agg(F.min("rank").alias("rank"))
    return M.first_wrong(C.gold(spark, d), dense)


def first_law_rows(spark: SparkSession, d: str) -> DataFrame:
    """M4: the first row of every law citation."""
    return C.first_rows(C.corpus(spark, d, court_rows=0))


PENALTY_MODES = ("df_only", "df_plus_dominance", "df_plus_dominance_plus_pattern")
TITLE_PATTERNS = ("^gesetz", "^verordnung vom <num>")
TITLE_TEMPLATES = ("gesetz vom <num> april <num> ueber den jagdnachweis",)


def penalty_modes(spark: SparkSession, d: str) -> DataFrame:
    """B12, N41 with all three modes, the quantiles of title frequency (B14) as thresholds and what hijacks the first 20."""
    shares = cut_lineage(EQ._title_shares(spark, d))
    quantiles = [r.threshold for r in E.nearest_rank_quantiles(shares, "df_share", [0.90, 0.95, 0.97, 0.99]).orderBy("q").collect()]
    grid = G.configs(spark, mode=list(PENALTY_MODES), level=[0, 1, 2, 3], strength=[0.3, 0.6])
    threshold = F.element_at(F.array(*[F.lit(q) for q in quantiles]), F.col("level").cast("int") + 1)
    grid = grid.withColumns({"w_citation": F.lit(2.0), "w_title": F.lit(2.0), "w_text": F.lit(1.0), "df_threshold": threshold, "dominance": F.lit(0.5), "low_citation": F.lit(0.3)})
    laws = C.corpus(spark, d, court_rows=0).where("norm <> ''").groupBy(F.col("norm").alias("citation")).agg(F.max_by(T.title_template("title"), "row_id").alias("template"))
    parts = G.components(EQ._raw_fields(spark, d)).join(shares, "citation", "left").fillna(0.0, subset=["df_share"]).join(laws, "citation", "left")
    parts = cut_lineage(parts.withColumn("pattern_hit", G.pattern_hit(F.coalesce("template", F.lit("")), list(TITLE_TEMPLATES), list(TITLE_PATTERNS))).drop("template"))
    rows = G.title_penalty(G.weigh(parts, grid))
    best = cut_lineage(G.ranked(rows, 200))
    hijacked = best.where("source = 'laws_de'").withColumn("_n", F.row_number().over(Window.partitionBy("config_id", "query_id").orderBy("rank"))).where("_n <= 20")
    hijacked = hijacked.withColumn("hijack", G.hijacks(hijacked)).groupBy("config_id").agg(F.count_if("hijack").alias("n_hijacked"))
    triggered = rows.groupBy("config_id").agg(F.count_if("triggered").alias("n_triggered"))
    return G.grid_recall(C.gold(spark, d), best, grid, (100, 200)).join(triggered, "config_id", "left").join(hijacked, "config_id", "left").fillna(0)


QUERIES = {
    f.__name__: f
    for f in (
        failure_cascade, three_way_fusion, seed_effectiveness, miss_reason_ratio, route_by_source, notebook_cuts, issue_groups_probe, issue_terms_probe, training_queries_probe, error_taxonomy_at_k, final_rescue_probe,
        explicit_families, plain_citations, numbered_laws, extraction_recall, contained_citations, bm25_okapi, dense_text_views, dense_court_views, negatives_family, negatives_first, negatives_dense,
        first_law_rows, penalty_modes,
    )
}

# ---- SQL ------------------------------------------------------------------------------------------------------------

_SRC = """src AS (SELECT query_id, split_part(list_id, '_', 1) AS kind, source, citation,
        CAST(row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, citation, source) AS INTEGER) AS rank,
        CAST(row_number() OVER (PARTITION BY query_id, list_id, source ORDER BY score DESC, citation) AS INTEGER) AS laws_rank FROM hits WHERE list_id IN ('sparse_bm25', 'dense_multi_view'))"""
_COURT = """court AS (SELECT * FROM (SELECT query_id, citation, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS INTEGER) AS rank FROM
        (SELECT query_id, citation, round(sum(CASE kind WHEN 'sparse' THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END / (59.0 + laws_rank)), 6) AS score FROM src WHERE source = 'court_considerations' GROUP BY ALL)) WHERE rank <= 220)"""
_RRF = "rrf AS (SELECT query_id, citation, round(sum(1.0 / (60.0 + rank)), 6) AS score FROM lists GROUP BY ALL)"
_BRANCH_VALUES = ", ".join(f"({S.q(b)})" for b in BRANCHES)
_FACTS = f"""WITH {S.CORPUS}, {ES.SOURCES}, {ES.NORMS}, {S.GOLD}, {ES.KNOWN}, {ES.PRED}, {RQ._LISTS}, {_SRC}, {_RRF},
    fused AS (SELECT * FROM (SELECT query_id, citation, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS INTEGER) AS rank FROM rrf) WHERE rank <= 320),
    ruled AS (SELECT query_id, citation, max(score) AS score FROM hits WHERE list_id IN ('rule_exact', 'rule_prefix') GROUP BY ALL),
    br AS (SELECT query_id, kind || CASE source WHEN 'laws_de' THEN '_laws' ELSE '_court' END AS branch, citation, min(laws_rank) AS rank FROM src GROUP BY ALL
        UNION ALL SELECT query_id, 'rule', citation, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS INTEGER) FROM ruled UNION ALL SELECT query_id, 'fusion_final', citation, rank FROM fused),
    raws AS (SELECT query_id, query, trim(unnest(CASE WHEN coalesce(gold, '') = '' THEN [''] ELSE string_split(gold, ';') END)) AS raw FROM questions),
    forms AS (SELECT query_id, query, raw, {S.norm('raw')} AS norm FROM raws),
    of_query AS (SELECT query_id, any_value(query) AS query, bool_or(regexp_matches(raw, {S.q(L.GOLD_PATTERN)})) AS patterned,
        bool_or(raw <> '' AND raw NOT IN (SELECT citation FROM source_map WHERE citation IS NOT NULL) AND norm IN (SELECT citation FROM source_map WHERE citation IS NOT NULL)) AS mismatch FROM forms GROUP BY query_id),
    n_rule AS (SELECT query_id, count(*) AS n_rules FROM ruled GROUP BY ALL),
    kinds AS (SELECT query_id, CASE WHEN bool_or(source = 'laws_de') AND NOT bool_or(source = 'court_considerations') THEN 'laws_only' WHEN bool_or(source = 'court_considerations') AND NOT bool_or(source = 'laws_de') THEN 'court_only' ELSE 'mixed' END AS sources
        FROM known JOIN source_map USING (citation) GROUP BY ALL),
    bn(branch) AS (VALUES {_BRANCH_VALUES}),
    ranks AS (SELECT k.query_id, bn.branch, count(*) AS n_known, coalesce(min(rank), -1) AS first_hit, count(*) FILTER (WHERE rank <= 200) AS at_200
        FROM known k CROSS JOIN bn LEFT JOIN br ON br.query_id = k.query_id AND br.branch = bn.branch AND br.citation = k.citation GROUP BY ALL),
    facts AS (SELECT o.query_id, bn.branch, coalesce(n_known, 0) AS n_known, CAST(coalesce(first_hit, -1) AS INTEGER) AS first_hit, coalesce(at_200, 0) AS at_200, coalesce(n_rules, 0) AS n_rules, patterned, mismatch, coalesce(sources, 'unknown') AS sources,
        length(regexp_replace(lower(query), '[^a-z]', '', 'g')) / greatest(length(query), 1) > 0.6 AS gap,
        o.query_id IN (SELECT query_id FROM known SEMI JOIN hits USING (query_id, citation)) AS in_union, o.query_id IN (SELECT query_id FROM known SEMI JOIN fused USING (query_id, citation)) AS in_fusion,
        o.query_id IN (SELECT query_id FROM known SEMI JOIN pred USING (query_id, citation)) AS in_final
        FROM of_query o CROSS JOIN bn LEFT JOIN n_rule ON n_rule.query_id = o.query_id LEFT JOIN kinds ON kinds.query_id = o.query_id LEFT JOIN ranks r ON r.query_id = o.query_id AND r.branch = bn.branch)"""
_SEEDS = f"""WITH {ES._GOLD_SOURCES}, {S.HITS}, {_SRC}, {_COURT}, {ES.CAND}, {S.VIEWS}, {S.ROUTED}, fused200 AS (SELECT * FROM cand WHERE rank <= 200),
    cs AS (SELECT query_id, {S.signals('text', L.CASE_SIGNALS)} AS c, {S.signals('text', L.STATUTE_SIGNALS)} AS s FROM routed),
    rt AS (SELECT query_id, CASE WHEN c > 0 AND s > 0 THEN 'hybrid' WHEN c > 0 THEN 'court' WHEN s > 0 THEN 'laws' ELSE 'hybrid' END AS route FROM cs),
    met AS (SELECT g.query_id, kind, source, rank FROM gold g JOIN src USING (query_id, citation)),
    fl AS (SELECT query_id, max(CAST(kind = 'sparse' AND source = 'laws_de' AS INTEGER)) AS sparse_laws, max(CAST(kind = 'sparse' AND source <> 'laws_de' AS INTEGER)) AS sparse_court,
        max(CAST(kind = 'dense' AND source = 'laws_de' AS INTEGER)) AS dense_laws, max(CAST(kind = 'dense' AND source <> 'laws_de' AS INTEGER)) AS dense_court,
        min(rank) FILTER (WHERE kind = 'sparse') AS best_sparse, min(rank) FILTER (WHERE kind = 'dense') AS best_dense FROM met GROUP BY ALL),
    bc AS (SELECT query_id, min(rank) AS best_court_rank FROM gold JOIN court USING (query_id, citation) GROUP BY ALL), bf AS (SELECT query_id, min(rank) AS best_fused FROM gold JOIN fused200 USING (query_id, citation) GROUP BY ALL),
    pl AS (SELECT query_id, count(*) AS pool FROM fused200 GROUP BY ALL), nc AS (SELECT query_id, count(*) AS n_court_rank FROM court GROUP BY ALL), nd AS (SELECT query_id, count(*) AS n_dense_court FROM src WHERE kind = 'dense' AND source <> 'laws_de' GROUP BY ALL),
    sd AS (SELECT q.query_id, route, CASE WHEN coalesce(n_court_rank, 0) > 0 THEN 'court_dense_threeway_rrf' ELSE 'fallback_full_rrf_due_empty_court_rank' END AS fusion_mode,
        coalesce(sparse_laws, 0) AS sparse_laws, coalesce(sparse_court, 0) AS sparse_court, coalesce(dense_laws, 0) AS dense_laws, coalesce(dense_court, 0) AS dense_court,
        coalesce(best_sparse, -1) AS best_sparse, coalesce(best_dense, -1) AS best_dense, coalesce(best_court_rank, -1) AS best_court_rank, coalesce(best_fused, -1) AS best_fused, coalesce(pool, 0) AS pool,
        CASE WHEN coalesce(best_fused, -1) > 0 THEN 'hit_in_fused_top200' WHEN coalesce(pool, 0) < 200 THEN 'candidate_pool_too_shallow' WHEN coalesce(n_dense_court, 0) = 0 THEN 'dense_not_triggered'
            WHEN coalesce(greatest(sparse_laws, sparse_court, dense_laws, dense_court), 0) = 0 THEN CASE WHEN contains(query, 'Art.') OR contains(query, 'BGE') OR contains(query, '_') THEN 'needs_anchor_rule' ELSE 'not_retrieved_sparse' END
            WHEN greatest(sparse_laws, sparse_court) = 1 AND greatest(dense_laws, dense_court) = 0 THEN 'not_retrieved_dense' WHEN greatest(dense_laws, dense_court) = 1 AND greatest(sparse_laws, sparse_court) = 0 THEN 'not_retrieved_sparse'
            WHEN coalesce(n_court_rank, 0) = 0 THEN 'lost_in_merge' ELSE 'eval_alignment_suspected' END AS miss_reason
        FROM (SELECT DISTINCT query_id FROM gold) q JOIN views USING (query_id) JOIN rt USING (query_id) LEFT JOIN fl USING (query_id) LEFT JOIN bc USING (query_id) LEFT JOIN bf USING (query_id) LEFT JOIN pl USING (query_id) LEFT JOIN nc USING (query_id) LEFT JOIN nd USING (query_id))"""
_PROBE = "WITH questions(query_id, query) AS (VALUES " + ", ".join(f"({S.q(i)}, {S.q(t)})" for i, t in _probes()) + f"), {S.FAMILIES}, {S.ISSUES}"
_PLAIN = "list_sort(list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), {1}), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '\\s+lit\\.\\s+[a-z]+', '', 'g'), '\\s+Ziff\\.\\s+\\d+', '', 'g'), '[\\s\\x0b]+', ' ', 'g')))))"


def _plain(x: str) -> str:
    return _PLAIN.format(x, S.q(L.PLAIN_ARTICLE))


def _numbered() -> str:
    out = "regexp_replace(regexp_replace(citation, '\\s+lit\\.\\s+[a-z]+', '', 'g'), '\\s+Ziff\\.\\s+\\d+', '', 'g')"
    for a, b in L.SR_NUMBERS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out})"


def _taxonomy() -> str:
    parts = []
    for k in (1, 3, 5, 20, 200):
        parts.append(f"SELECT label, n, {k} AS k FROM (SELECT {ES._TAXONOMY} AS label, count(*) AS n FROM ({ES._ROUND} aware_{k}) GROUP BY ALL)")
    ctes = ", ".join(
        f"p_{k} AS (SELECT query_id, coalesce(canonical, citation) AS citation FROM cand LEFT JOIN lookup ON norm = citation WHERE rank <= {k}), {ES.f1(f'a_{k}', 'gold_c', f'p_{k}')}, aware_{k} AS (SELECT a.* REPLACE (coalesce(m, 0) AS missing_gold) FROM a_{k} a LEFT JOIN miss USING (query_id))"
        for k in (1, 3, 5, 20, 200)
    )
    return f"""WITH {S.CORPUS}, {ES.LOOKUP}, {S.GOLD}, {ES.CAND}, gk AS (SELECT query_id, citation AS raw, canonical FROM gold LEFT JOIN lookup ON norm = citation),
        gold_c AS (SELECT query_id, canonical AS citation FROM gk WHERE canonical IS NOT NULL), miss AS (SELECT query_id, count(*) FILTER (WHERE canonical IS NULL) AS m FROM gk GROUP BY ALL), {ctes} {' UNION ALL '.join(parts)}"""


def _negatives_sql(order: str) -> str:
    return f"""WITH {S.CORPUS}, {S.GOLD}, {RQ._LISTS}, {_RRF}, fused AS (SELECT * FROM (SELECT query_id, citation, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS INTEGER) AS rank FROM rrf) WHERE rank <= 200),
        laws AS (SELECT DISTINCT norm AS citation FROM corpus WHERE source = 'laws_de' AND norm <> ''), gl AS (SELECT query_id, list(DISTINCT nullif({S.family_first('citation')}, '')) AS fams FROM gold SEMI JOIN laws USING (citation) GROUP BY query_id),
        pool AS (SELECT f.query_id, f.citation, f.rank, CAST(coalesce(list_contains(fams, {S.family_first('f.citation')}), false) AS INTEGER) AS same_family FROM fused f JOIN gl ON gl.query_id = f.query_id
            WHERE f.citation IN (SELECT citation FROM laws) AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = f.query_id AND g.citation = f.citation))
        SELECT query_id, citation AS negative, rank AS negative_rank, same_family FROM pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}) = 1"""


SQL = {
    "failure_cascade": f"""{_FACTS} SELECT query_id, branch, n_known, first_hit, CASE WHEN n_known = 0 THEN 'no_gold_in_candidates' WHEN first_hit = -1 AND gap THEN 'query_language_gap'
        WHEN first_hit = -1 AND patterned AND n_rules = 0 THEN 'citation_pattern_missed' WHEN mismatch THEN 'normalization_mismatch' WHEN branch LIKE '%laws' AND sources = 'court_only' THEN 'source_mismatch'
        WHEN branch LIKE '%court' AND sources = 'laws_only' THEN 'source_mismatch' WHEN branch = 'fusion_final' AND in_union AND NOT in_fusion THEN 'gold_lost_in_fusion' WHEN at_200 = 0 THEN 'no_gold_in_candidates'
        WHEN first_hit > 50 THEN 'gold_only_after_large_k' WHEN branch = 'fusion_final' AND in_fusion AND NOT in_final THEN 'gold_lost_in_final_cut' ELSE 'ok' END AS failure FROM facts""",
    "three_way_fusion": f"""WITH {S.HITS}, {_SRC}, {_COURT}, cq AS (SELECT DISTINCT query_id FROM court),
        parts AS (SELECT query_id, citation, laws_rank AS rank, true AS three FROM src WHERE source = 'laws_de' AND query_id IN (SELECT query_id FROM cq) UNION ALL SELECT query_id, citation, rank, true FROM court
            UNION ALL SELECT query_id, citation, rank, false FROM src WHERE query_id NOT IN (SELECT query_id FROM cq)),
        f AS (SELECT query_id, citation, round(sum(1.0::DOUBLE / (60.0 + rank)), 6) AS score, CASE WHEN bool_or(three) THEN 'court_dense_threeway_rrf' ELSE 'fallback_full_rrf_due_empty_court_rank' END AS mode FROM parts GROUP BY ALL)
        {RQ._top('f', 'query_id', 'score DESC, citation', 320)}""",
    "seed_effectiveness": f"{_SEEDS} SELECT * FROM sd",
    "miss_reason_ratio": f"{_SEEDS} SELECT miss_reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM sd), 6) AS ratio FROM sd GROUP BY miss_reason",
    "route_by_source": f"""{_SEEDS}, j AS (SELECT sd.*, gold_source FROM sd JOIN gold_sources USING (query_id)), dom AS (SELECT route, gold_source FROM (SELECT DISTINCT route FROM j), (VALUES ('laws_only'), ('court_only'), ('mixed'), ('unknown')) t(gold_source)),
        md AS (SELECT route, gold_source, fusion_mode, count(*) AS m FROM j GROUP BY ALL), ms AS (SELECT route, gold_source, string_agg(fusion_mode || ':' || m, ';' ORDER BY fusion_mode) AS modes FROM md GROUP BY ALL),
        rates AS (SELECT route, gold_source, count(*) AS n, round(count(*) FILTER (WHERE best_fused > 0) / count(*), 6) AS recall_at_200, round(CAST(sum(sparse_court) AS DOUBLE) / count(*), 6) AS sparse_court_rate, round(CAST(sum(dense_court) AS DOUBLE) / count(*), 6) AS dense_court_rate FROM j GROUP BY ALL)
        SELECT route, gold_source, coalesce(n, 0) AS n, coalesce(recall_at_200, 0.0) AS recall_at_200, coalesce(sparse_court_rate, 0.0) AS sparse_court_rate, coalesce(dense_court_rate, 0.0) AS dense_court_rate, coalesce(modes, '') AS modes
        FROM dom LEFT JOIN rates USING (route, gold_source) LEFT JOIN ms USING (route, gold_source)""",
    "notebook_cuts": f"""{ES._RERANKED}, lg AS (SELECT query_id, citation, round(rerank_score - 0.2::DOUBLE, 6) AS x, rerank_rank AS r FROM reranked), lb AS (SELECT *, max(x) OVER (PARTITION BY query_id) AS best FROM lg),
        cuts AS (SELECT 'positive' AS mode, query_id, citation FROM lb WHERE x > 0 UNION ALL SELECT 'top', query_id, citation FROM lb WHERE r <= 3 UNION ALL SELECT 'adaptive', query_id, citation FROM lb WHERE CASE WHEN best > 0 THEN x >= best * 0.8::DOUBLE ELSE r = 1 END),
        dom AS (SELECT query_id, mode FROM questions, (VALUES ('positive'), ('top'), ('adaptive')) t(mode)) SELECT query_id, mode, coalesce(citation, '{DEFAULT_CITATION}') AS citation FROM dom LEFT JOIN cuts USING (query_id, mode)""",
    "issue_groups_probe": f"{_PROBE} SELECT query_id, rank, name FROM issues",
    "issue_terms_probe": _PROBE + ES.TEXT["issue_terms"].split(S.ISSUES, 1)[1],
    "error_taxonomy_at_k": _taxonomy(),
    "final_rescue_probe": f"""{ES._CANDIDATES}, gf AS (SELECT DISTINCT query_id, {S.family_first('citation')} AS family FROM (SELECT query_id, unnest({S.split('gold')}) AS citation FROM questions) WHERE {S.family_first('citation')} <> '')
        SELECT query_id, citation, fused_rank FROM c0 WHERE source = 'laws_de' AND fused_rank > 5 AND EXISTS (SELECT 1 FROM gf WHERE gf.query_id = c0.query_id AND gf.family = {S.family_first('c0.citation')})
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) <= 2""",
    "explicit_families": f"""WITH {S.QUESTIONS}, t AS (SELECT query_id, concat_ws(' ', query, gold) AS t FROM questions), f AS (SELECT query_id, list_distinct_ AS l FROM (SELECT query_id, {S.distinct('l')} AS list_distinct_ FROM (SELECT query_id, list_filter([
        {', '.join(f"CASE WHEN regexp_matches({S.bounded('t')}, '(?i)\\b{f}\\b') THEN '{f}' END" for f in L.FAMILIES_FIRST)}, {', '.join(f"CASE WHEN regexp_matches({S.bounded('t')}, {S.q(p)}) THEN '{f}' END" for f, p in L.CODE_NAMES)}], lambda x: x IS NOT NULL) AS l FROM t)))
        SELECT query_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS family FROM f""",
    "plain_citations": f"SELECT row_id, unnest({_plain('text')}) AS citation FROM court_considerations",
    "numbered_laws": f"WITH {S.CORPUS} SELECT source, row_id, {_numbered()} AS numbered FROM corpus",
    "extraction_recall": f"""WITH {S.QUESTIONS}, r AS (SELECT {_plain("concat_ws(' ', query, gold)")} AS found, list_distinct(list_filter(string_split(coalesce(gold, ''), ';'), lambda x: x <> '')) AS gold FROM questions),
        c AS (SELECT CAST(sum(len(gold)) AS BIGINT) AS n_gold, CAST(sum(len(found)) AS BIGINT) AS n_extracted, CAST(sum(len(list_intersect(gold, found))) AS BIGINT) AS n_hits FROM r) SELECT *, round(coalesce(n_hits / nullif(n_gold, 0), 0.0), 6) AS recall FROM c""",
    "contained_citations": f"""WITH {S.CORPUS}, {S.QUESTIONS}, pat AS (SELECT DISTINCT unnest({_plain('gold')}) AS pattern FROM questions), cd AS (SELECT DISTINCT source, citation FROM corpus WHERE citation <> '')
        SELECT pattern, count(*) AS n, min(citation) AS first FROM pat JOIN cd ON contains(citation, pattern) GROUP BY pattern""",
    "bm25_okapi": f"""WITH {S.CORPUS}, tok AS (SELECT row_id, list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda w: w <> '') AS t FROM corpus WHERE source = 'laws_de'), wh AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
        df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM tok) GROUP BY term), rw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df, wh), mn AS (SELECT avg(raw) AS mean FROM rw),
        qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda w: w <> '')) AS term FROM eval_items) GROUP BY ALL),
        ps AS (SELECT row_id, term, dl, count(*) AS tf FROM (SELECT row_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
        sc AS (SELECT item_id, row_id, round(sum(qtf * CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN rw USING (term) JOIN ps USING (term), wh, mn GROUP BY ALL)
        {RQ._top('sc', 'item_id', 'score DESC, row_id', 3)}""",
    "negatives_family": _negatives_sql("same_family DESC, rank"),
    "negatives_first": _negatives_sql("rank"),
    "negatives_dense": f"""WITH {S.GOLD}, {RQ._LISTS}, dn AS (SELECT query_id, citation, min(rank) AS rank FROM lists WHERE list_id = 'dense_multi_view' GROUP BY ALL)
        SELECT query_id, citation AS negative, rank AS negative_rank FROM dn WHERE rank <= 15 AND query_id IN (SELECT query_id FROM gold) AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = dn.query_id AND g.citation = dn.citation)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, citation) = 1""",
    "first_law_rows": f"WITH {S.CORPUS} SELECT norm, min(row_id) AS row_id FROM corpus WHERE source = 'laws_de' AND norm <> '' GROUP BY norm",
    "penalty_modes": f"""WITH {S.CORPUS}, {ES._SHARES}, {S.GOLD}, {S.HITS}, {ES._FIELDS}, {ES._grid({'mode': list(PENALTY_MODES), 'level': [0, 1, 2, 3], 'strength': [0.3, 0.6]})},
        th AS (SELECT unnest([0, 1, 2, 3]) AS level, unnest(quantile_disc(df_share, [0.90, 0.95, 0.97, 0.99])) AS threshold FROM shares),
        w0 AS (SELECT config_id, mode, strength, threshold, query_id, source, citation, c * 2.0::DOUBLE AS c, t * 2.0::DOUBLE AS t, x * 1.0::DOUBLE AS x, coalesce(df_share, 0.0) AS df,
            coalesce(regexp_matches(template, '^gesetz') OR regexp_matches(template, '^verordnung vom <num>') OR template = {S.q(TITLE_TEMPLATES[0])}, false) AS ph
            FROM parts LEFT JOIN shares USING (citation) LEFT JOIN titled USING (citation), grid JOIN th ON th.level = grid.level),
        w1 AS (SELECT *, df >= threshold AS hi, t / (c + t + x + 1e-9) >= 0.5 AND c / (c + t + x + 1e-9) <= 0.3 AS dom FROM w0),
        w2 AS (SELECT *, source = 'laws_de' AND t > 0 AND CASE mode WHEN 'df_only' THEN hi WHEN 'df_plus_dominance' THEN hi AND dom ELSE hi AND dom AND ph END AS triggered FROM w1),
        weighed AS (SELECT * REPLACE (CASE WHEN triggered THEN t * greatest(0.0::DOUBLE, 1.0::DOUBLE - strength) ELSE t END AS t) FROM w2), {ES._recall('weighed')},
        trig AS (SELECT config_id, count(*) FILTER (WHERE triggered) AS n_triggered FROM weighed GROUP BY ALL),
        b2 AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY round(greatest(c, t, x), 6) DESC, citation, source) AS rank FROM weighed QUALIFY rank <= 200),
        b3 AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY rank) AS n FROM b2 WHERE source = 'laws_de'),
        hj AS (SELECT config_id, count(*) FILTER (WHERE df >= threshold AND (mode = 'df_only' OR t / (c + t + x + 1e-9) >= 0.5 AND c / (c + t + x + 1e-9) <= 0.3) AND (mode <> 'df_plus_dominance_plus_pattern' OR ph)) AS n_hijacked FROM b3 WHERE n <= 20 GROUP BY ALL)
        SELECT r.*, coalesce(n_triggered, 0) AS n_triggered, coalesce(n_hijacked, 0) AS n_hijacked FROM results r LEFT JOIN trig USING (config_id) LEFT JOIN hj USING (config_id)""",
}
