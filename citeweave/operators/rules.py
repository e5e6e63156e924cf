"""Rule recall: what a query's numbered patterns name, by exact, prefix and relaxed match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.sparse import top_k

#: Letters of a relaxed pattern that it is met by; the rest is checked.
KEY = 10


def query_patterns(queries: DataFrame) -> DataFrame:
    """J4 applied: query_id, pattern (normalised, small letters), family, is_article."""
    rows = queries.select("query_id", F.explode(T.rule_patterns("query")).alias("raw"))
    rows = rows.select("query_id", F.lower(T.normalize_citation("raw")).alias("pattern"), T.family_last("raw").alias("family"), F.rlike("raw", F.lit(r"(?i)\b(?:art\.?|article)\s*\d+")).alias("is_article"))
    return rows.where("pattern <> ''").distinct()


def relaxed(pattern: Column) -> Column:
    """The pattern as an expression in which blanks may be wider, and dots missing or followed by blanks."""
    out = F.regexp_replace(pattern, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(out, r"\\\.", r"\\.?\\s*"), " ", r"\\s+")


def bare(c: Column) -> Column:
    """Without blanks and dots: what a relaxed pattern and any text it matches have in common."""
    return F.regexp_replace(c, r"[\s.]+", "")


def _starts(patterns: DataFrame, docs: DataFrame) -> DataFrame:
    """Patterns with the citations that begin with them: citations are cut at every length that patterns have."""
    lengths = sorted(r[0] for r in patterns.select(F.length("pattern")).distinct().collect())
    heads = F.array(*[F.when(F.length("norm") >= n, F.left("norm", F.lit(n))) for n in lengths]) if lengths else F.array().cast("array<string>")
    return docs.withColumn("pattern", F.explode(F.filter(heads, lambda h: h.isNotNull()))).join(patterns, "pattern")


def _inside(patterns: DataFrame, docs: DataFrame) -> DataFrame:
    """Patterns with the citations that hold them in relaxed form. Both are bared; every stretch of a citation as long as the
    key of some pattern meets the patterns with that key, and the relaxed expression is tried on these only."""
    keyed = patterns.withColumn("_k", F.left(bare(F.col("pattern")), F.lit(KEY))).where("_k <> ''")
    lengths = sorted(r[0] for r in keyed.select(F.length("_k")).distinct().collect())
    if not lengths:
        return docs.join(keyed, F.lit(False)).drop("_k")

    def of_length(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("_b") - n + 1, F.lit(1))), lambda i: F.substring(F.col("_b"), i, F.lit(n)))

    stretches = F.flatten(F.array(*[of_length(n) for n in lengths]))
    rows = docs.withColumn("_b", bare(F.col("norm"))).withColumn("_k", F.explode(F.array_distinct(stretches))).drop("_b")
    return rows.join(keyed, "_k").where(F.rlike("norm", relaxed(F.col("pattern")))).drop("_k")


def contained(patterns: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (norm) that hold a ``pattern`` as it stands, by the stretches that both have; no theta join."""
    keyed = patterns.where("pattern <> ''").withColumn("_k", F.left("pattern", F.lit(KEY)))
    lengths = sorted(r[0] for r in keyed.select(F.length("_k")).distinct().collect())
    if not lengths:
        return docs.join(keyed, F.lit(False)).drop("_k")

    def of_length(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("norm") - n + 1, F.lit(1))), lambda i: F.substring(F.col("norm"), i, F.lit(n)))

    rows = docs.withColumn("_k", F.explode(F.array_distinct(F.flatten(F.array(*[of_length(n) for n in lengths])))))
    return rows.join(keyed, "_k").where(F.contains("norm", F.col("pattern"))).drop("_k")


def search(queries: DataFrame, corpus: DataFrame, k_laws: int, k_court: int) -> DataFrame:
    """query_id, source, citation, score, method, rank: the ``k`` best citations of each source.

    A citation counts 1.0 if the pattern is its normalised text (of several spellings, the last row's), 0.8 if it begins with
    the pattern and is of no other law, and, for decisions, 0.6 if it holds the pattern anywhere in relaxed form. All three
    are equi-joins: on the text, on its beginnings, on its stretches. An article pattern without a known family is not
    searched in the laws. A source with k = 0 is not read. Ties go to the citation that sorts first; a question without
    patterns has no rows.
    """
    patterns = query_patterns(queries)
    docs = corpus.where("norm <> ''").where(F.col("source").isin(*[s for s, k in (("laws_de", k_laws), ("court_considerations", k_court)) if k > 0]))
    row = F.col("row_id") if "row_id" in corpus.columns else F.lit(0)
    docs = docs.select("source", row.alias("row_id"), "citation", F.lower("norm").alias("norm"), T.family_last("citation").alias("law"))
    docs = docs.groupBy("source", "citation", "norm", "law").agg(F.max("row_id").alias("row_id"))
    admitted = (F.col("source") != "laws_de") | ~F.col("is_article") | (F.col("family") != "")
    same_law = (F.col("family") == "") | (F.col("law") == "") | (F.col("family") == F.col("law"))
    named = docs.groupBy("source", "norm").agg(F.max_by("citation", F.struct("row_id", "citation")).alias("citation"))
    hit = lambda rows, score, method: rows.select("query_id", "source", "citation", F.lit(score).alias("score"), F.lit(method).alias("method"))
    exact = hit(named.withColumnRenamed("norm", "pattern").join(patterns, "pattern").where(admitted), 1.0, "rule_exact")
    prefix = hit(_starts(patterns, docs).where(same_law & admitted), 0.8, "rule_prefix")
    inside = hit(_inside(patterns, docs.where("source = 'court_considerations'")), 0.6, "rule_regex")
    found = exact.unionByName(prefix).unionByName(inside)
    best = found.groupBy("query_id", "source", "citation").agg(F.max(F.struct("score", "method")).alias("b")).select("query_id", "source", "citation", "b.score", "b.method")
    ranked = top_k(best, ["query_id", "source"], [F.desc("score"), F.asc("citation")], max(k_laws, k_court))
    return ranked.where(F.when(F.col("source") == "laws_de", F.col("rank") <= k_laws).otherwise(F.col("rank") <= k_court))
