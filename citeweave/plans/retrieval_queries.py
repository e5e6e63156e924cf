"""Queries over sparse, dense and rule retrieval and over fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import lexicons as L
from citeweave.functions import text as T
from citeweave.functions import understanding as U
from citeweave.operators import corpus as C
from citeweave.operators import dense as D
from citeweave.operators import fusion as FU
from citeweave.operators import rules as R
from citeweave.operators import sparse as SP
from citeweave.plans import sql_text as S
from citeweave.plans.text_queries import query_views
from citeweave.runtime import scratch, table

# ---- sparse ---------------------------------------------------------------------------------------------------------


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = C.corpus(spark, d).where("norm <> ''")
    text = T.joined(F.col("norm"), F.col("title"), F.col("text"))
    return SP.term_stats(rows, text, ["source"]).select("source", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Documents for every evaluation item (a fixed query set), the ten best each."""
    docs = table(spark, d, "documents").select(F.lit("all").alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items = table(spark, d, "eval_items")
    best = SP.search(docs, F.col("text"), ["source"], ["doc_id"], items, "item_id", F.col("text"), 10)
    return best.select("item_id", "rank", "doc_id", "score")


def searched(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: questions whose row_id is divisible by 100."""
    return query_views(spark, d).where("row_id % 100 = 0")


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with all that BM25 reads of a row in one text."""
    return C.corpus(spark, d).where("norm <> ''").withColumn("body", T.joined(F.col("norm"), F.col("title"), F.col("text")))


def bm25_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The best rows of each source."""
    return SP.search(_bodies(spark, d), F.col("body"), ["source"], ["row_id"], searched(spark, d), "query_id", F.col("query"), 20)


def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same search from an index that is written once and read by term."""
    folder = scratch(spark, "bm25")
    SP.save_index(_bodies(spark, d), F.col("body"), ["source"], ["row_id"], folder)
    return SP.search_index(spark, folder, ["source"], ["row_id"], searched(spark, d), "query_id", F.col("query"), 20)


def bm25_multi_view(spark: SparkSession, d: str) -> DataFrame:
    """Original, keyword and German views, boosted 1.0, 0.9 and 0.9; the best score of a row counts."""
    q = searched(spark, d)
    german = U.german_view(U.german_keywords("clean", L.GENERAL_EN_DE), L.GENERAL_SNIPPETS, "numbers")
    views = q.select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("view"), F.lit(b).alias("boost"), t.alias("text")) for n, b, t in (("original", 1.0, F.col("query")), ("keywords", 0.9, F.array_join("words", " ")), ("german", 0.9, german))])).alias("v"))
    views = views.select(F.concat_ws("|", "query_id", "v.view").alias("query_id"), "v.text", "v.boost")
    scores = SP.search(_bodies(spark, d), F.col("body"), ["source"], ["row_id"], views, "query_id", F.col("text"), 40, per_group=False, boost="boost")
    best = scores.groupBy(F.split("query_id", "\\|")[0].alias("query_id"), "source", "row_id").agg(F.max("score").alias("score"))
    return SP.top_k(best, ["query_id"], [F.desc("score"), F.asc("source"), F.asc("row_id")], 40)


FIELD_WEIGHTS = {"citation": 2.0, "title": 2.0, "text": 1.0}


def bm25_field_aware(spark: SparkSession, d: str) -> DataFrame:
    """The best of every field before weighting; the winning field of a row stays with it."""
    rows = C.fields_of(C.corpus(spark, d).where("norm <> ''"))
    cut = SP.search(rows, F.col("body"), ["source", "field"], ["row_id"], searched(spark, d), "query_id", F.col("query"), 40).drop("rank")
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in FIELD_WEIGHTS.items()])
    weighted = cut.withColumn("score", F.round(F.col("score") * weight, 6))
    best = weighted.groupBy("query_id", "source", "row_id").agg(F.max("score").alias("score"), F.max_by("field", F.struct("score", "field")).alias("field"))
    return SP.top_k(best, ["query_id"], [F.desc("score"), F.asc("source"), F.asc("row_id")], 40)


# ---- dense ----------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors under the two sources: even labels stand for laws, odd ones for decisions."""
    source = F.when(F.col("label") % 2 == 0, "laws_de").otherwise("court_considerations")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), source.alias("source"), "embedding")


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return D.dense_top_k(_vectors(spark, d), _probes(spark, d), 10)


def dense_source_blocks(spark: SparkSession, d: str) -> DataFrame:
    return D.dense_blocks(_vectors(spark, d), _probes(spark, d), 10, 5)


def dense_multi_view(spark: SparkSession, d: str) -> DataFrame:
    """A vector and its reversed half as two views, boosted 1.0 and 0.9; the best score counts."""
    probes = _probes(spark, d)
    first = D.dense_scores(_vectors(spark, d), probes, 20)
    second = D.dense_scores(_vectors(spark, d), probes.select("query_id", F.reverse("embedding").alias("embedding")), 20).withColumn("score", F.round(F.col("score") * 0.9, 6))
    cut = [SP.top_k(v, ["query_id", "source"], [F.desc("score"), F.asc("id")], 20) for v in (first, second)]
    best = cut[0].unionByName(cut[1]).groupBy("query_id", "source", "id").agg(F.max("score").alias("score"))
    return SP.top_k(best, ["query_id"], [F.desc("score"), F.asc("id")], 20)


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """D3: vectors of the laws' citations and titles."""
    rows = C.corpus(spark, d, court_rows=0)
    return D.hashed_vectors(rows, "row_id", T.joined(F.col("norm"), F.col("title")), dims=64)


# ---- rules ----------------------------------------------------------------------------------------------------------


def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """What the numbered patterns of all questions name, by source."""
    return R.search(C.questions(spark, d), C.corpus(spark, d), 60, 60)


def rule_hits_typed(spark: SparkSession, d: str) -> DataFrame:
    """J1-J6 for citations as people type them: the gold fields read as queries."""
    return R.search(C.questions(spark, d).select("query_id", F.coalesce("gold", F.lit("")).alias("query")), C.corpus(spark, d), 60, 60)


# ---- fusion ---------------------------------------------------------------------------------------------------------


def lists(spark: SparkSession, d: str) -> DataFrame:
    """The branches' lists, ranked whole; a hot list takes many tasks."""
    return FU.rank_whole(C.hits(spark, d))


def rrf(spark: SparkSession, d: str) -> DataFrame:
    return FU.reciprocal_rank(lists(spark, d), 20)


def rrf_source_weighted(spark: SparkSession, d: str) -> DataFrame:
    return FU.reciprocal_rank(lists(spark, d), 20, laws=1.2, court=0.8)


def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return FU.min_max(lists(spark, d), {"sparse_bm25": 0.6, "dense_multi_view": 0.4, "rule_exact": 0.35}, 20)


def branch_metadata(spark: SparkSession, d: str) -> DataFrame:
    return FU.branch_metadata(lists(spark, d), "sparse_text")


def branch_bonus(spark: SparkSession, d: str) -> DataFrame:
    ranked = lists(spark, d)
    return FU.branch_aware(FU.reciprocal_rank(ranked, 10**6), FU.branch_metadata(ranked, "sparse_text"), 20, "bonus", 0.2, 0.1)


def branch_rescue(spark: SparkSession, d: str) -> DataFrame:
    ranked = lists(spark, d)
    return FU.branch_aware(FU.reciprocal_rank(ranked, 10**6), FU.branch_metadata(ranked, "sparse_text"), 20, "rescue", 0.5, 0.5)


def dedup_keep_max(spark: SparkSession, d: str) -> DataFrame:
    return FU.keep_best(C.hits(spark, d), ["query_id", "citation"])


def merge_lists(spark: SparkSession, d: str) -> DataFrame:
    return FU.merge_lists(C.hits(spark, d), ["rule_exact", "rule_prefix", "sparse_citation", "sparse_title", "sparse_text"])


def dedup_ranked(spark: SparkSession, d: str) -> DataFrame:
    return FU.first_occurrences(lists(spark, d), 8)


def court_fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    court = lists(spark, d).where("source = 'court_considerations'").select("query_id", "list_id", "citation", "rank")
    sparse, dense = court.where("list_id = 'sparse_text'").drop("list_id"), court.where("list_id = 'dense_multi_view'").drop("list_id")
    return FU.court_fusion(sparse, dense, 1.5, 20)


def _with_families(spark: SparkSession, d: str) -> DataFrame:
    """All hits of the branches with their question's predicted families."""
    families = C.questions(spark, d).select("query_id", U.likely_families("query").alias("families"))
    return C.hits(spark, d).join(families, "query_id")


def family_boost(spark: SparkSession, d: str) -> DataFrame:
    boosted = FU.family_boost(_with_families(spark, d).where("size(families) > 0"), 2.5)
    return boosted.select("query_id", "list_id", "source", "citation", F.round("score", 6).alias("score"), "method", "rank")


def family_constrain(spark: SparkSession, d: str) -> DataFrame:
    return FU.family_constrain(_with_families(spark, d), 5).select("query_id", "list_id", "source", "citation")


def family_filter(spark: SparkSession, d: str) -> DataFrame:
    return FU.family_filter(_with_families(spark, d)).select("query_id", "list_id", "source", "citation")


def federated_decisions(spark: SparkSession, d: str) -> DataFrame:
    return FU.federated(C.hits(spark, d), 5).select("query_id", "rank", "citation", "source", "list_id")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_term_stats, bm25_topk, bm25_per_source, bm25_stored, bm25_multi_view, bm25_field_aware, dense_topk, dense_source_blocks, dense_multi_view, hashed_vectors, rule_hits, rule_hits_typed, rrf, rrf_source_weighted,
        weighted_fusion, branch_metadata, branch_bonus, branch_rescue, dedup_keep_max, merge_lists, dedup_ranked, court_fuse_weighted, family_boost, family_constrain, family_filter, federated_decisions,
    )
}

# ---- SQL ------------------------------------------------------------------------------------------------------------


def _bm25_sql(docs: str, keys: str, group: str, terms: str, query_id: str, name: str = "scores") -> str:
    """docs(keys, body) and terms(query_id, term, qtf) -> scores(query_id, keys, score)."""
    on = " AND ".join(f"p.{g} = s.{g}" for g in group.split(", "))
    return f"""
    {name}_tok AS (SELECT {keys}, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS t FROM {docs}),
    {name}_cnt AS (SELECT {group}, count(*) AS n, avg(len(t)) AS avgdl FROM {name}_tok GROUP BY ALL),
    {name}_post AS (SELECT {keys}, term, len_ AS dl, count(*) AS tf FROM (SELECT {keys}, len(t) AS len_, unnest(t) AS term FROM {name}_tok) GROUP BY ALL),
    {name}_stat AS (SELECT {', '.join('d.' + g for g in group.split(', '))}, term, df, n, avgdl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf
        FROM (SELECT {group}, term, count(*) AS df FROM {name}_post GROUP BY ALL) d JOIN {name}_cnt c ON {' AND '.join(f'd.{g} = c.{g}' for g in group.split(', '))}),
    {name} AS (SELECT q.{query_id}, {', '.join('p.' + k for k in keys.split(', '))}, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (avgdl + 1e-9)) + 1e-9)), 6) AS score
        FROM {terms} q JOIN {name}_stat s ON q.term = s.term JOIN {name}_post p ON p.term = s.term AND {on} GROUP BY ALL)"""


def _terms_sql(name: str, source: str, query_id: str, text: str) -> str:
    return f"{name} AS (SELECT {query_id}, term, count(*) AS qtf FROM (SELECT {query_id}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {source}) GROUP BY ALL)"


_BODY = "SELECT source, row_id, trim(concat_ws(' ', norm, title, text)) AS body FROM corpus WHERE norm <> ''"
_SEARCHED = f"{S.QUESTIONS}, {S.VIEWS}, searched AS (SELECT * FROM views WHERE row_id % 100 = 0)"
_LISTS = f"""{S.HITS}, lists AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, citation, source) AS INTEGER) AS rank FROM hits)"""
_DENSE = """
    vec AS (SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'laws_de' ELSE 'court_considerations' END AS source, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    probe AS (SELECT id AS query_id, e FROM vec WHERE id % 100 = 0)"""


def _top(source: str, partition: str, order: str, k: int, cols: str = "*", rank: str = "rank") -> str:
    window = f"row_number() OVER (PARTITION BY {partition} ORDER BY {order})"
    return f"SELECT {cols}, CAST({window} AS INTEGER) AS {rank} FROM {source} QUALIFY {window} <= {k}"


def _rrf_sql(factor: str = "1.0") -> str:
    return f"rrf AS (SELECT query_id, citation, round(sum({factor} / (60.0 + rank)), 6) AS score FROM lists GROUP BY ALL)"


_META = """
    meta0 AS (SELECT query_id, citation, count(DISTINCT list_id) AS n_branches, bool_or(list_id = 'sparse_text') AS in_main, min(CASE WHEN list_id = 'sparse_text' THEN rank END) AS f FROM lists GROUP BY ALL),
    meta AS (SELECT query_id, citation, n_branches, in_main, CASE WHEN in_main THEN CAST(row_number() OVER (PARTITION BY query_id ORDER BY f NULLS LAST) AS INTEGER) ELSE 1000000000 END AS main_rank FROM meta0)"""
_GERMAN_ROWS = S.german("gde", L.GENERAL_EN_DE)
_MULTI = f"""WITH {S.CORPUS}, {_SEARCHED}, {_GERMAN_ROWS}, docs AS ({_BODY}),
    v AS (SELECT s.query_id || '|original' AS query_id, query AS text, 1.0 AS boost FROM searched s
        UNION ALL SELECT s.query_id || '|keywords', array_to_string(words, ' '), 0.9 FROM searched s
        UNION ALL SELECT s.query_id || '|german', trim(concat_ws(' ', g.words, CASE WHEN g.words IS NOT NULL THEN {S.q(' '.join(L.GENERAL_SNIPPETS))} END,
            nullif(array_to_string(list_transform(numbers[1:8], lambda x: lower(x)), ' '), ''))), 0.9 FROM searched s LEFT JOIN gde g ON g.query_id = s.query_id),
    {_terms_sql('terms', 'v', 'query_id', 'text')}, {_bm25_sql('docs', 'source, row_id', 'source', 'terms', 'query_id')},
    best AS (SELECT string_split(s.query_id, '|')[1] AS query_id, source, row_id, round(max(score * boost), 6) AS score FROM scores s JOIN v USING (query_id) GROUP BY ALL)
    {_top('best', 'query_id', 'score DESC, source, row_id', 40)}"""
_FIELDS = f"""fdocs AS (SELECT source, 'citation' AS field, row_id, norm AS body FROM corpus WHERE norm <> ''
        UNION ALL SELECT source, 'title', row_id, title FROM corpus WHERE norm <> '' AND source = 'laws_de' UNION ALL SELECT source, 'text', row_id, text FROM corpus WHERE norm <> ''),
    {_bm25_sql('fdocs', 'source, field, row_id', 'source, field', 'terms', 'query_id')}"""
_FAMILY_HITS = f"""{S.QUESTIONS}, {S.FAMILIES}, {S.HITS}, fam AS (SELECT query_id, list(family) AS families FROM likely GROUP BY query_id),
    fh AS (SELECT h.*, coalesce(families, []) AS families, list_contains(coalesce(families, []), nullif({S.family_first('h.citation')}, '')) AS matched
        FROM hits h JOIN questions USING (query_id) LEFT JOIN fam USING (query_id))"""

def _rules_sql(query: str) -> str:
    return f"""WITH {S.CORPUS}, {S.QUESTIONS}, raw AS (SELECT query_id, unnest({S.first_by_lower(S.matches(query, L.RULE_PATTERNS))}) AS raw FROM questions),
        pat AS (SELECT DISTINCT query_id, lower({S.norm('raw')}) AS pattern, {S.family_last('raw')} AS family, regexp_matches(raw, '(?i)\\b(?:art\\.?|article)\\s*\\d+') AS is_article FROM raw WHERE {S.norm('raw')} <> ''),
        rdocs AS (SELECT source, citation, lower(norm) AS norm, {S.family_last('citation')} AS law, max(row_id) AS row_id FROM corpus WHERE norm <> '' GROUP BY ALL),
        named AS (SELECT source, norm, arg_max(citation, {{'r': row_id, 'c': citation}}) AS citation FROM rdocs GROUP BY ALL),
        found AS (SELECT query_id, source, citation, 1.0::DOUBLE AS score, 'rule_exact' AS method FROM pat JOIN named ON pattern = norm WHERE source <> 'laws_de' OR NOT is_article OR family <> ''
            UNION ALL SELECT query_id, source, citation, 0.8::DOUBLE, 'rule_prefix' FROM pat JOIN rdocs ON starts_with(norm, pattern)
                WHERE (source <> 'laws_de' OR NOT is_article OR family <> '') AND (family = '' OR law = '' OR family = law)
            UNION ALL SELECT query_id, source, citation, 0.6::DOUBLE, 'rule_regex' FROM pat JOIN rdocs ON regexp_matches(norm,
                replace(replace(regexp_replace(pattern, '([^\\p{{L}}\\p{{N}}_\\s])', '\\\\\\1', 'g'), '\\.', '\\.?\\s*'), ' ', '\\s+')) WHERE source = 'court_considerations'),
        best AS (SELECT query_id, source, citation, max(score) AS score, arg_max(method, score) AS method FROM found GROUP BY ALL)
        {_top('best', 'query_id, source', 'score DESC, citation', 60)}"""


SQL = {
    "bm25_term_stats": f"""WITH {S.CORPUS}, docs AS ({_BODY}), none(query_id, term, qtf) AS (SELECT 0, '', 0 WHERE false), {_bm25_sql('docs', 'source, row_id', 'source', 'none', 'query_id')}
        SELECT source, term, df, round(idf, 6) AS idf FROM scores_stat""",
    "bm25_topk": f"""WITH docs AS (SELECT 'all' AS source, doc_id, coalesce(text, '') AS body FROM documents), {_terms_sql('terms', 'eval_items', 'item_id', 'text')},
        {_bm25_sql('docs', 'source, doc_id', 'source', 'terms', 'item_id')} {_top('scores', 'item_id', 'score DESC, doc_id', 10, 'item_id, doc_id, score')}""",
    "bm25_per_source": f"""WITH {S.CORPUS}, {_SEARCHED}, docs AS ({_BODY}), {_terms_sql('terms', 'searched', 'query_id', 'query')}, {_bm25_sql('docs', 'source, row_id', 'source', 'terms', 'query_id')}
        {_top('scores', 'query_id, source', 'score DESC, row_id', 20)}""",
    "bm25_multi_view": _MULTI,
    "bm25_stored": f"""WITH {S.CORPUS}, {_SEARCHED}, docs AS ({_BODY}), {_terms_sql('terms', 'searched', 'query_id', 'query')}, {_bm25_sql('docs', 'source, row_id', 'source', 'terms', 'query_id')}
        {_top('scores', 'query_id, source', 'score DESC, row_id', 20)}""",
    "bm25_field_aware": f"""WITH {S.CORPUS}, {_SEARCHED}, {_terms_sql('terms', 'searched', 'query_id', 'query')}, {_FIELDS},
        cut AS ({_top('scores', 'query_id, source, field', 'score DESC, row_id', 40)}),
        weighted AS (SELECT * REPLACE (round(score * CASE field WHEN 'text' THEN 1.0 ELSE 2.0 END, 6) AS score) FROM cut),
        best AS (SELECT query_id, source, row_id, max(score) AS score, arg_max(field, {{'score': score, 'field': field}}) AS field FROM weighted GROUP BY ALL)
        {_top('best', 'query_id', 'score DESC, source, row_id', 40)}""",
    "dense_topk": f"""WITH {_DENSE}, s AS (SELECT p.query_id, v.source, v.id, round(list_dot_product(p.e, v.e), 6) AS score FROM probe p, vec v),
        c AS ({_top('s', 'query_id, source', 'score DESC, id', 10, '*', 'source_rank')}) {_top('c', 'query_id', 'score DESC, id', 20)}""",
    "dense_source_blocks": f"""WITH {_DENSE}, s AS (SELECT p.query_id, v.source, v.id, round(list_dot_product(p.e, v.e), 6) AS score FROM probe p, vec v),
        c AS ({_top('s', 'query_id, source', 'score DESC, id', 10, '*', 'source_rank')}), b AS (SELECT * FROM c WHERE source = 'laws_de' OR source_rank <= 5)
        {_top('b', 'query_id', "CASE source WHEN 'laws_de' THEN 0 ELSE 1 END, source_rank", 15)}""",
    "dense_multi_view": f"""WITH {_DENSE}, s AS (SELECT p.query_id, v.source, v.id, round(list_dot_product(p.e, v.e), 6) AS score FROM probe p, vec v),
        r AS (SELECT p.query_id, v.source, v.id, round(round(list_dot_product(list_reverse(p.e), v.e), 6) * 0.9, 6) AS score FROM probe p, vec v),
        c AS ({_top('s', 'query_id, source', 'score DESC, id', 20)} UNION ALL {_top('r', 'query_id, source', 'score DESC, id', 20)}),
        best AS (SELECT query_id, source, id, max(score) AS score FROM c GROUP BY ALL) {_top('best', 'query_id', 'score DESC, id', 20)}""",
    "rule_hits": _rules_sql("query"),
    "rule_hits_typed": _rules_sql("gold"),
    "rrf": f"WITH {_LISTS}, {_rrf_sql()} {_top('rrf', 'query_id', 'score DESC, citation', 20)}",
    "rrf_source_weighted": f"""WITH {_LISTS}, {_rrf_sql("CASE source WHEN 'laws_de' THEN 1.2 WHEN 'court_considerations' THEN 0.8 ELSE 1.0 END")} {_top('rrf', 'query_id', 'score DESC, citation', 20)}""",
    "weighted_fusion": f"""WITH {_LISTS}, w(list_id, w) AS (VALUES ('sparse_bm25', 0.6), ('dense_multi_view', 0.4), ('rule_exact', 0.35)),
        spread AS (SELECT *, min(score) OVER (PARTITION BY query_id, list_id) AS lo, max(score) OVER (PARTITION BY query_id, list_id) AS hi FROM lists),
        f AS (SELECT query_id, citation, round(sum(CAST(w AS DOUBLE) * (score - lo) / (hi - lo + 1e-9)), 6) AS score FROM spread JOIN w USING (list_id) GROUP BY ALL) {_top('f', 'query_id', 'score DESC, citation', 20)}""",
    "branch_metadata": f"WITH {_LISTS}, {_META} SELECT * FROM meta",
    "branch_bonus": f"""WITH {_LISTS}, {_rrf_sql()}, ranked AS ({_top('rrf', 'query_id', 'score DESC, citation', 10**6, '*', 'base_rank')}), {_META},
        b AS (SELECT query_id, citation, base_rank, round(score * (1.0::DOUBLE + CASE WHEN in_main THEN 0.2::DOUBLE + CASE WHEN n_branches = 1 THEN 0.1::DOUBLE ELSE 0.0 END ELSE 0.0 END), 6) AS score FROM ranked LEFT JOIN meta USING (query_id, citation))
        {_top('b', 'query_id', 'score DESC, base_rank', 20)}""",
    "branch_rescue": f"""WITH {_LISTS}, {_rrf_sql()}, ranked AS ({_top('rrf', 'query_id', 'score DESC, citation', 10**6, '*', 'base_rank')}), {_META},
        b AS (SELECT query_id, citation, base_rank, round(score * CASE WHEN in_main AND n_branches = 1 AND main_rank <= 200 AND base_rank > 20 THEN 2.0::DOUBLE ELSE 1.0 END, 6) AS score FROM ranked LEFT JOIN meta USING (query_id, citation))
        {_top('b', 'query_id', 'score DESC, base_rank', 20)}""",
    "dedup_keep_max": f"WITH {S.HITS} SELECT query_id, citation, max(score) AS score FROM hits GROUP BY ALL",
    "merge_lists": f"""WITH {S.HITS}, o AS (SELECT *, CASE list_id WHEN 'rule_exact' THEN 0 WHEN 'rule_prefix' THEN 1 WHEN 'sparse_citation' THEN 2 WHEN 'sparse_title' THEN 3 WHEN 'sparse_text' THEN 4 ELSE 5 END AS p FROM hits)
        SELECT query_id, citation, source, max(score) AS score, arg_min(list_id, {{'s': -score, 'p': p, 'l': list_id}}) AS method FROM o GROUP BY ALL""",
    "dedup_ranked": f"WITH {_LISTS}, f AS (SELECT query_id, citation, min(rank) AS first_ FROM lists GROUP BY ALL) {_top('f', 'query_id', 'first_, citation', 8, 'query_id, citation')}",
    "court_fuse_weighted": f"""WITH {_LISTS}, f AS (SELECT query_id, citation, round(sum(CASE list_id WHEN 'sparse_text' THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END / (59.0 + rank)), 6) AS score FROM lists
        WHERE source = 'court_considerations' AND list_id IN ('sparse_text', 'dense_multi_view') GROUP BY ALL) {_top('f', 'query_id', 'score DESC, citation', 20)}""",
    "family_boost": f"WITH {_FAMILY_HITS} SELECT query_id, list_id, source, citation, round(score, 6) AS score, CASE WHEN coalesce(matched, false) THEN list_id || '_family' ELSE list_id END AS method, CAST(row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, citation, source) AS INTEGER) AS rank FROM (SELECT * REPLACE (CASE WHEN coalesce(matched, false) THEN score * 2.5::DOUBLE ELSE score END AS score) FROM fh) WHERE len(families) > 0",
    "family_constrain": f"WITH {_FAMILY_HITS}, c AS (SELECT *, count_if(coalesce(matched, false)) OVER (PARTITION BY query_id) AS n FROM fh) SELECT query_id, list_id, source, citation FROM c WHERE n < 5 OR coalesce(matched, false)",
    "family_filter": f"WITH {_FAMILY_HITS} SELECT query_id, list_id, source, citation FROM fh WHERE len(families) = 0 OR coalesce(matched, false)",
    "federated_decisions": f"""WITH {S.HITS}, x AS (SELECT * FROM hits WHERE contains(citation, 'BGE') OR contains(citation, '_') OR contains(citation, '/'))
        {_top('x', 'query_id', 'score DESC, citation, source, list_id', 5, 'query_id, citation, source, list_id')}""",
}
