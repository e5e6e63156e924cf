"""The pipelines end to end, for all queries at once, from one configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import lexicons as L
from citeweave.functions import text as T
from citeweave.functions import understanding as U
from citeweave.operators import corpus as C
from citeweave.operators import fusion as FU
from citeweave.operators import rerank as RR
from citeweave.operators import rules as R
from citeweave.operators import sparse as SP
from citeweave.runtime import cut_lineage


@dataclass(frozen=True)
class Config:
    """Defaults are those of the laws-first run; dead switches do not exist here."""

    rule_top_k: int = 20
    field_weights: dict = field(default_factory=lambda: {"citation": 2.0, "title": 2.0, "text": 1.0})
    sparse_floor: int = 0
    dense_floor: int = 0
    family_boost: float = 2.5
    family_min_keep: int = 5
    family_constraints: bool = True
    issue_view: bool = True
    issue_top_k: int = 24
    issue_boost: float = 2.5
    fused_top: int = 320
    rerank_input_shaping: bool = False
    evidence_calibration: bool = False
    evidence_top_n: int = 80
    cut_mode: str = "fixed"
    fixed_top_k: int = 5
    score_threshold: float = 0.15
    relative_threshold: float = 0.85
    rescue_top_k: int = 1
    text_chars: int | None = None


def understand(questions: DataFrame, config: Config) -> DataFrame:
    """Stages 2-7: one select over the questions."""
    q = questions.select("query_id", "query", T.clean_query("query").alias("clean"), T.number_patterns("query").alias("numbers"), T.rule_patterns("query").alias("patterns"), U.likely_families("query").alias("families"))
    q = q.withColumns({"words": T.keywords("clean"), "explicit": F.size("patterns") > 0})
    german = U.german_view(U.german_keywords("clean", L.LAWS_EN_DE), L.LAWS_SNIPPETS, "numbers", always=True)
    q = q.withColumns({"route": U.route(U.routed_text("query", "numbers"))["route"], "issue": F.array_join(U.issue_terms(U.issue_groups("query", "families")), " ")})
    q = q.withColumn("quota", U.quotas("route", config.sparse_floor, config.dense_floor))
    family_words = F.array_join(U.family_terms("families"), " ")
    return q.withColumn("laws_text", T.joined(T.sparse_view("clean", "words", "numbers"), german, F.when(F.size("families") > 0, family_words)))


def read_text(text: str, chars: int | None) -> Column:
    """The whole text, or its first ``chars`` characters if a run asks for that."""
    return F.col(text) if chars is None else F.left(text, F.lit(chars))


def field_search(fields: DataFrame, queries: DataFrame, text: str, weights: dict[str, float], k: int) -> DataFrame:
    """Best weighted field of every row: query_id, source, citation, score. ``fields``: source, field, row_id, citation, body."""
    worth = {f: w for f, w in weights.items() if w > 0}
    rows = fields.where(F.col("field").isin(*worth))
    cut = SP.search(rows, F.col("body"), ["source", "field"], ["row_id"], queries, "query_id", F.col(text), k, carry=("citation",))
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in worth.items()])
    best = cut.withColumn("score", F.col("score") * weight).where("score > 0")
    return best.groupBy("query_id", "source", "citation").agg(F.max("score").alias("score"))


def quota_cut(hits: DataFrame, queries: DataFrame, branch: str, most: int = 120) -> DataFrame:
    """the first hits of each source up to the query's quota; the literal cut comes first."""
    ranked = SP.top_k(hits, ["query_id", "source"], [F.desc("score"), F.asc("citation")], most)
    rows = ranked.join(queries.select("query_id", "quota", "families"), "query_id")
    allowed = F.when(F.col("source") == "laws_de", F.col(f"quota.laws_{branch}")).otherwise(F.col(f"quota.court_{branch}"))
    return rows.where(F.col("rank") <= allowed).drop("quota", "rank")


def with_families(hits: DataFrame, config: Config) -> DataFrame:
    matched = F.coalesce(FU.family_match(), F.lit(False))
    rows = hits.withColumn("score", F.when(matched, F.col("score") * max(1.0, config.family_boost)).otherwise(F.col("score")))
    return FU.family_constrain(rows, config.family_min_keep) if config.family_constraints else rows


def laws_first(questions: DataFrame, corpus: DataFrame, dense: DataFrame | None = None, config: Config = Config(), reranker: RR.Reranker = RR.token_overlap) -> DataFrame:
    """Pipeline A: query_id, rank, citation. ``dense``: hits (query_id, source, citation, score) of an encoder, if any."""
    # Understood once: every later stage would otherwise plan and evaluate the whole of it again.
    queries = cut_lineage(understand(questions, config))
    rules = R.search(questions, corpus, config.rule_top_k, 0).select("query_id", F.col("citation"), "rank")
    fields = C.fields_of(corpus.where("norm <> ''").withColumn("text", read_text("text", config.text_chars)))
    sparse = quota_cut(field_search(fields, queries, "laws_text", config.field_weights, 120), queries, "sparse")
    sparse = with_families(sparse, config)
    if config.issue_view:
        wanted = queries.where("NOT explicit AND size(families) > 0 AND issue <> ''")
        issue = field_search(fields.where("source = 'laws_de'"), wanted, "issue", {"citation": 0.0, "title": 2.0, "text": 3.0}, config.issue_top_k)
        issue = issue.join(queries.select("query_id", "families"), "query_id").withColumn("score", F.col("score") * config.issue_boost)
        sparse = sparse.unionByName(issue).groupBy("query_id", "source", "citation", "families").agg(F.max("score").alias("score"))
    lists = [sparse.withColumn("list_id", F.lit("sparse"))]
    if dense is not None:
        lists.append(with_families(quota_cut(dense, queries, "dense", 80), config).withColumn("list_id", F.lit("dense")))
    hits = lists[0]
    for more in lists[1:]:
        hits = hits.unionByName(more)
    ranked = cut_lineage(FU.rank_lists(hits))
    fused = FU.reciprocal_rank(ranked, config.fused_top).select("query_id", "citation", F.col("score").alias("fused_score"), F.col("rank").alias("fused_rank"))
    sources = ranked.groupBy("query_id", "citation").agg(F.min("source").alias("source"), F.max((F.col("list_id") == "dense").cast("int")).alias("v"), F.max((F.col("list_id") == "sparse").cast("int")).alias("s"))
    docs = corpus.where("norm <> ''").groupBy(F.col("norm").alias("citation")).agg(F.max_by(F.struct("title", "text"), F.struct("source", "row_id")).alias("d"))
    docs = docs.select("citation", F.concat_ws(" ", "citation", "d.title", read_text("d.text", config.text_chars)).alias("body"))
    ruled = rules.select("query_id", "citation").distinct().withColumn("is_rule", F.lit(1))
    rows = fused.join(sources, ["query_id", "citation"]).join(docs, "citation").join(ruled, ["query_id", "citation"], "left").fillna(0, ["is_rule"])
    rows = rows.join(queries.select("query_id", "query", "families", "explicit"), "query_id")
    rows = rows.withColumns({"is_family": F.coalesce(FU.family_match(), F.lit(False)).cast("int"), "is_issue": F.lit(0), "is_both": F.col("s") * F.col("v"), "is_dense_only": F.when((F.col("v") == 1) & (F.col("s") == 0), 1).otherwise(0)})
    # The candidates are few (at most fused_top a query) and used three times.
    rows, rules = cut_lineage(rows), cut_lineage(rules)
    if config.rerank_input_shaping:
        shaped = RR.shape_input(rows.withColumns({"is_laws": (F.col("source") == "laws_de").cast("int"), "pool_score": F.col("fused_score")}), config.fused_top, config.fused_top // 2)
        rows = shaped.drop("is_laws", "pool_score", "tier", "input_rank")
    reranked = RR.rerank(rows, reranker, config.fused_top)
    if config.evidence_calibration:
        reranked = RR.calibrate(reranked, config.evidence_top_n).withColumn("rerank_rank", F.col("calibrated_rank")).withColumn("rerank_score", F.col("calibrated_score"))
    final = RR.cut(reranked, config.cut_mode, config.fixed_top_k, config.score_threshold, config.relative_threshold)
    done = final.select("query_id", "citation").unionByName(rules.select("query_id", "citation"))
    rescued = RR.rescue(rows, done, config.rescue_top_k).select("query_id", "citation", F.col("fused_rank").alias("rank"))
    return RR.ordered_union(rules, final.select("query_id", "citation", F.col("rerank_rank").alias("rank")), rescued)


def baseline(
    hits: DataFrame, queries: DataFrame, docs: DataFrame, weights: dict[str, float] | None = None, top_n: int = 10, reranker: RR.Reranker = RR.token_overlap, depth: int | None = None
) -> DataFrame:
    """Pipeline B over scored hits of any branches (query_id, list_id, source, citation, score): weighted fusion if
    weights are given, else reciprocal ranks; then rerank to ``top_n``. ``docs``: citation, source, body. ``depth``: the
    ranks of a list that count (all, if none is given)."""
    ranked = FU.rank_whole(hits)
    ranked = ranked if depth is None else ranked.where(F.col("rank") <= depth)
    pool = max(3 * top_n, 40)
    fused = FU.min_max(ranked, weights, pool) if weights else FU.reciprocal_rank(ranked, pool)
    rows = fused.select("query_id", "citation", F.col("score").alias("fused_score"), F.col("rank").alias("fused_rank")).join(docs, "citation", "left")
    rows = rows.withColumn("body", F.coalesce("body", "citation")).join(queries.select("query_id", "query"), "query_id")
    return RR.rerank(rows, reranker, top_n).select("query_id", F.col("rerank_rank").alias("rank"), "citation")


def bm25_baseline(questions: DataFrame, corpus: DataFrame, top_n: int = 8) -> DataFrame:
    """Pipeline C: one index over both sources, fifty best rows, first occurrences of their citations."""
    docs = corpus.where("norm <> ''").withColumn("all", F.lit("all"))
    body = T.joined(F.col("norm"), F.col("title"), F.col("text"))
    docs = docs.select("all", "source", "row_id", F.col("norm").alias("citation"), body.alias("body"))
    ranked = SP.search(docs, F.col("body"), ["all"], ["source", "row_id"], questions, "query_id", F.col("query"), 50, carry=("citation",))
    first = ranked.groupBy("query_id", "citation").agg(F.min("rank").alias("_first"))
    order = Window.partitionBy("query_id").orderBy("_first")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).select("query_id", "rank", "citation")


def run(spark, settings: dict, sf_dir: str) -> DataFrame:
    """A pipeline from a configuration, as ``read_json`` gives it: ``pipeline`` (laws_first, baseline or bm25), ``query_filter``
    (a condition over the questions), and for laws_first the fields of ``Config``. Gives query_id, rank, citation."""
    questions = C.questions(spark, sf_dir)
    if settings.get("query_filter"):
        questions = questions.where(settings["query_filter"])
    name = settings.get("pipeline", "laws_first")
    options = {k: v for k, v in settings.items() if k in Config.__dataclass_fields__}
    if name == "bm25":
        return bm25_baseline(questions, C.corpus(spark, sf_dir), settings.get("top_n", 8))
    if name == "laws_first":
        dense = C.hits(spark, sf_dir).where("list_id = 'dense_multi_view'").drop("list_id")
        return laws_first(questions, C.corpus(spark, sf_dir), dense, Config(**options))
    if name == "baseline":
        docs = C.doc_lookup(C.corpus(spark, sf_dir)).select(F.col("norm").alias("citation"), "source", T.joined(F.col("norm"), F.col("title"), F.col("text")).alias("body"))
        return baseline(C.hits(spark, sf_dir), questions, docs, settings.get("weights"), settings.get("top_n", 10), depth=settings.get("depth"))
    raise ValueError(f"unknown pipeline {name}")
