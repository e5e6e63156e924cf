"""Queries over text functions and query understanding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import lexicons as L
from citeweave.functions import text as T
from citeweave.functions import understanding as U
from citeweave.operators import corpus as C
from citeweave.plans import sql_text as S


def normalize_citation(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus(spark, d).select("source", "row_id", "norm")


def split_citations(spark: SparkSession, d: str) -> DataFrame:
    return C.questions(spark, d).select("query_id", F.posexplode(T.split_citations("gold")).alias("pos", "citation"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = C.corpus(spark, d).select("source", F.explode(T.tokens("text")).alias("term"))
    return rows.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))


def query_views(spark: SparkSession, d: str) -> DataFrame:
    """Everything a query is searched by."""
    base = C.questions(spark, d).select("query_id", "row_id", "query", T.clean_query("query").alias("clean"), T.number_patterns("query").alias("numbers"))
    base = base.withColumn("words", T.keywords("clean"))
    return base.withColumn("phrases", T.legal_phrases("clean", "words", "numbers"))


def clean_query(spark: SparkSession, d: str) -> DataFrame:
    return query_views(spark, d).select("query_id", "clean")


def number_patterns(spark: SparkSession, d: str) -> DataFrame:
    return query_views(spark, d).select("query_id", F.posexplode("numbers").alias("pos", "pattern"))


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return query_views(spark, d).select("query_id", F.posexplode("words").alias("pos", "word"))


def legal_phrases(spark: SparkSession, d: str) -> DataFrame:
    return query_views(spark, d).select("query_id", F.posexplode("phrases").alias("pos", "phrase"))


def retrieval_views(spark: SparkSession, d: str) -> DataFrame:
    return query_views(spark, d).select("query_id", T.sparse_view("clean", "words", "numbers").alias("sparse_query"), T.dense_view("clean", "phrases").alias("dense_query"))


def statute_families(spark: SparkSession, d: str) -> DataFrame:
    rows = C.corpus(spark, d)
    return rows.select("source", "row_id", T.family_or_last("norm").alias("family_or_last"), T.family_last("norm").alias("family_last"), T.family_first("norm").alias("family_first"))


def citation_tokens(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus(spark, d).select("source", "row_id", F.explode(T.citation_tokens("norm")).alias("token"))


def paragraph_keys(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus(spark, d).select("source", "row_id", T.paragraph_key("norm").alias("paragraph_key"))


def likely_families(spark: SparkSession, d: str) -> DataFrame:
    rows = C.questions(spark, d).select("query_id", F.posexplode(U.likely_families("query")).alias("rank", "family"))
    return rows.withColumn("rank", F.col("rank") + 1)


def issue_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = C.questions(spark, d).select("query_id", F.posexplode(U.issue_groups("query", U.likely_families("query"))).alias("rank", "name"))
    return rows.withColumn("rank", F.col("rank") + 1)


def issue_terms(spark: SparkSession, d: str) -> DataFrame:
    groups = C.questions(spark, d).select("query_id", U.issue_groups("query", U.likely_families("query")).alias("groups"))
    return groups.select("query_id", F.posexplode(U.issue_terms("groups")).alias("pos", "term"))


def family_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = C.questions(spark, d).select("query_id", U.likely_families("query").alias("families"))
    return rows.select("query_id", F.posexplode(U.family_terms("families")).alias("pos", "term"))


def german_views(spark: SparkSession, d: str) -> DataFrame:
    """The German sides of the general, laws, statute-style and court packs."""
    v = query_views(spark, d)
    packs = {"de": (L.GENERAL_EN_DE, L.GENERAL_SNIPPETS, 8, False), "laws": (L.LAWS_EN_DE, L.LAWS_SNIPPETS, 8, True), "laws_v2": (L.STATUTE_STYLE_EN_DE, L.STATUTE_STYLE_SNIPPETS + L.LAWS_SNIPPETS, 10, True), "court": (L.COURT_EN_DE, L.COURT_SNIPPETS, 8, True)}
    return v.select("query_id", *[U.german_view(U.german_keywords("clean", lex), snip, "numbers", most, always).alias(n) for n, (lex, snip, most, always) in packs.items()])


def route_counts(spark: SparkSession, d: str) -> DataFrame:
    return query_views(spark, d).select("query_id", U.route(U.routed_text("query", "numbers")).alias("r")).select("query_id", "r.*")


def route_scores(spark: SparkSession, d: str) -> DataFrame:
    return query_views(spark, d).select("query_id", U.route_scored(U.routed_text("query", "numbers")).alias("r")).select("query_id", "r.*")


def route_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = query_views(spark, d).select("query_id", U.route(U.routed_text("query", "numbers"))["route"].alias("route"))
    return rows.select("query_id", "route", U.quotas("route").alias("q")).select("query_id", "route", "q.*")


def title_templates(spark: SparkSession, d: str) -> DataFrame:
    """How common each title template of the laws is."""
    rows = C.corpus(spark, d, court_rows=0).where("norm <> ''").groupBy(T.title_template("title").alias("template")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("template", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def query_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Citations and words of each question."""
    rows = C.questions(spark, d)
    return rows.select("query_id", F.size(T.split_citations("gold")).alias("n_citations"), F.size(F.regexp_extract_all("query", F.lit(r"\S+"), 0)).alias("n_words"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_citation, split_citations, tokenize_counts, clean_query, number_patterns, keywords, legal_phrases, retrieval_views, statute_families, citation_tokens,
        paragraph_keys, likely_families, issue_groups, issue_terms, family_terms, german_views, route_counts, route_scores, route_quota, title_templates, query_statistics,
    )
}

_V = f"WITH {S.QUESTIONS}, {S.VIEWS}"
_F = f"WITH {S.QUESTIONS}, {S.FAMILIES}"
_FAMILY_WORDS = ", ".join(f"({S.q(f)}, {n}, {S.q(t)})" for f, terms in L.FAMILY_TERMS.items() for n, t in enumerate(terms))


def _german_sql() -> str:
    packs = {"de": (L.GENERAL_EN_DE, L.GENERAL_SNIPPETS, 8), "laws": (L.LAWS_EN_DE, L.LAWS_SNIPPETS, 8), "laws_v2": (L.STATUTE_STYLE_EN_DE, L.STATUTE_STYLE_SNIPPETS + L.LAWS_SNIPPETS, 10), "court": (L.COURT_EN_DE, L.COURT_SNIPPETS, 8)}
    ctes = ", ".join(S.german(f"g_{n}", lex) for n, (lex, _, _) in packs.items())
    cols = []
    for n, (_, snippets, most) in packs.items():
        standing = S.q(" ".join(snippets))
        standing = f"CASE WHEN g_{n}.words IS NOT NULL THEN {standing} END" if n == "de" else standing
        cols.append(f"trim(concat_ws(' ', g_{n}.words, {standing}, nullif(array_to_string(list_transform(numbers[1:{most}], lambda v: lower(v)), ' '), ''))) AS {n}")
    joins = " ".join(f"LEFT JOIN g_{n} ON g_{n}.query_id = views.query_id" for n in packs)
    return f"{_V}, {ctes} SELECT views.query_id, {', '.join(cols)} FROM views {joins}"


_CASE, _STATUTE = S.signals("text", L.CASE_SIGNALS), S.signals("text", L.STATUTE_SIGNALS)
_KINDS = " + ".join(f"CAST(regexp_matches(text, {S.q(p)}) AS INTEGER)" for p in L.CASE_SIGNALS.values())
_ROUTE = f"""{_V}, {S.ROUTED}, counted AS (SELECT query_id, {_CASE} AS c, {_STATUTE} AS s, {_KINDS} AS kinds FROM routed),
    decided AS (SELECT query_id, CASE WHEN c > 0 AND s > 0 THEN 'hybrid' WHEN c > 0 THEN 'court' WHEN s > 0 THEN 'laws' ELSE 'hybrid' END AS route,
        CASE WHEN c > 0 AND s > 0 THEN CASE WHEN c + s >= 3 THEN 'high' ELSE 'medium' END WHEN c + s = 0 THEN 'low' WHEN c + s >= 2 THEN 'high' ELSE 'medium' END AS confidence,
        CAST(c AS INTEGER) AS case_signals, CAST(s AS INTEGER) AS statute_signals FROM counted)"""

SQL = {
    "normalize_citation": f"WITH {S.CORPUS} SELECT source, row_id, norm FROM corpus",
    "split_citations": f"WITH {S.QUESTIONS}, l AS (SELECT query_id, {S.split('gold')} AS l FROM questions) SELECT query_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS citation FROM l",
    "tokenize_counts": f"WITH {S.CORPUS}, t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM corpus) SELECT source, term, count(*) AS n FROM t GROUP BY ALL",
    "clean_query": f"{_V} SELECT query_id, clean FROM views",
    "number_patterns": f"{_V} SELECT query_id, CAST(unnest(range(len(numbers))) AS INTEGER) AS pos, unnest(numbers) AS pattern FROM views",
    "keywords": f"{_V} SELECT query_id, CAST(unnest(range(len(words))) AS INTEGER) AS pos, unnest(words) AS word FROM views",
    "legal_phrases": f"{_V} SELECT query_id, CAST(unnest(range(len(phrases))) AS INTEGER) AS pos, unnest(phrases) AS phrase FROM views",
    "retrieval_views": f"""{_V} SELECT query_id, trim(concat_ws(' ', clean, nullif(array_to_string(words[1:12], ' '), ''), nullif(array_to_string(numbers[1:8], ' '), ''))) AS sparse_query,
        trim(concat_ws(' ', clean, nullif(array_to_string(phrases[1:8], ' '), ''))) AS dense_query FROM views""",
    "statute_families": f"WITH {S.CORPUS} SELECT source, row_id, {S.family_or_last('norm')} AS family_or_last, {S.family_last('norm')} AS family_last, {S.family_first('norm')} AS family_first FROM corpus",
    "citation_tokens": f"""WITH {S.CORPUS}, low AS (SELECT source, row_id, lower(norm) AS t FROM corpus) SELECT DISTINCT source, row_id, unnest(flatten([
        regexp_extract_all(t, '\\b(?:art|abs|lit|ziff?|para|section|article)\\b'),
        list_filter(list_transform(regexp_extract_all(t, '\\b[a-z]{{2,8}}\\b'), lambda w: upper(w)), lambda w: w IN {S.in_list(L.FAMILIES_LAST)}),
        regexp_extract_all(t, '\\b\\d{{1,4}}\\b')])) AS token FROM low""",
    "paragraph_keys": f"WITH {S.CORPUS} SELECT source, row_id, {S.paragraph_key('norm')} AS paragraph_key FROM corpus",
    "likely_families": f"{_F} SELECT query_id, rank, family FROM likely",
    "issue_groups": f"{_F}, {S.ISSUES} SELECT query_id, rank, name FROM issues",
    "issue_terms": f"""{_F}, {S.ISSUES}, flat AS (SELECT query_id, term, min(rank * 100 + ord) AS pos FROM issues JOIN issue_words USING (name) GROUP BY query_id, lower(term), term),
        once AS (SELECT query_id, term, pos FROM flat QUALIFY row_number() OVER (PARTITION BY query_id, lower(term) ORDER BY pos) = 1)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS INTEGER) AS pos, term FROM once QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 16""",
    "family_terms": f"""{_F}, words(family, ord, term) AS (VALUES {_FAMILY_WORDS}), once AS (SELECT query_id, term, rank * 100 + ord AS pos FROM likely JOIN words USING (family)
        QUALIFY row_number() OVER (PARTITION BY query_id, lower(term) ORDER BY rank * 100 + ord) = 1) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS INTEGER) AS pos, term FROM once""",
    "german_views": _german_sql(),
    "route_counts": f"{_ROUTE} SELECT * FROM decided",
    "route_scores": f"""{_V}, {S.ROUTED}, counted AS (SELECT query_id, {_CASE} + CASE WHEN {_KINDS} >= 2 THEN 1 ELSE 0 END AS c, {_STATUTE} AS s FROM routed)
        SELECT query_id,
            CASE WHEN least(c, s) >= 1 THEN 'hybrid' WHEN c >= 2 AND c - s >= 1 THEN 'court' WHEN s >= 2 AND s - c >= 1 THEN 'laws' ELSE 'hybrid' END AS route,
            CASE WHEN least(c, s) >= 1 THEN CASE WHEN least(c, s) >= 2 THEN 'high' ELSE 'medium' END
                WHEN (c >= 2 AND c - s >= 1) OR (s >= 2 AND s - c >= 1) THEN CASE WHEN greatest(c, s) >= 3 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence,
            CAST(c AS DOUBLE) AS case_score, CAST(s AS DOUBLE) AS statute_score, CAST(least(c, s) AS DOUBLE) AS mixed_score FROM counted""",
    "route_quota": f"""{_ROUTE} SELECT query_id, route, CASE route WHEN 'laws' THEN 100 WHEN 'court' THEN 20 ELSE 60 END AS laws_sparse, CASE route WHEN 'laws' THEN 20 WHEN 'court' THEN 100 ELSE 60 END AS court_sparse,
        CASE route WHEN 'laws' THEN 60 WHEN 'court' THEN 20 ELSE 40 END AS laws_dense, CASE route WHEN 'laws' THEN 20 WHEN 'court' THEN 60 ELSE 40 END AS court_dense FROM decided""",
    "title_templates": f"""WITH {S.CORPUS}, t AS (SELECT {S.title_template('title')} AS template FROM corpus WHERE source = 'laws_de' AND norm <> '')
        SELECT template, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY template""",
    "query_statistics": f"WITH {S.QUESTIONS} SELECT query_id, CAST(len({S.split('gold')}) AS INTEGER) AS n_citations, CAST(len(regexp_extract_all(query, '\\S+')) AS INTEGER) AS n_words FROM questions",
}
