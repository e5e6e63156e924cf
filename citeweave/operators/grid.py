"""Parameter grids over scores computed once: every later key is (config_id, query_id)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T


def configs(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of the axes: config_id (in the order of the axes) and a column for each."""
    rows = [(i, *values) for i, values in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, ["config_id", *axes])


def components(fields: DataFrame) -> DataFrame:
    """Raw scores by field beside one another: query_id, source, citation, c, t, x (0 where a field has no hit)."""
    return fields.groupBy("query_id", "source", "citation").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("score"))), F.lit(0.0)).alias(a) for f, a in (("citation", "c"), ("title", "t"), ("text", "x"))])


def weigh(parts: DataFrame, grid: DataFrame) -> DataFrame:
    """Every candidate under every config, its best weighted field as score. The grid is a list of parameters."""
    rows = parts.crossJoin(F.broadcast(grid))
    return rows.withColumns({a: F.col(a) * F.col(w) for a, w in (("c", "w_citation"), ("t", "w_title"), ("x", "w_text"))})


def pattern_hit(template: Column, exact: list[str], patterns: list[str]) -> Column:
    """The title's mould is one of the exact ones or matches a pattern."""
    return F.coalesce(template.isin(*exact), F.lit(False)) | F.coalesce(F.greatest(*[F.rlike(template, F.lit(p)) for p in [*patterns, *patterns[:1]]]), F.lit(False)) if patterns else F.coalesce(template.isin(*exact), F.lit(False))


def hijacks(rows: DataFrame) -> Column:
    """Whether a title from a common mould carries a row, by the ``mode`` of its config. Needs the columns of
    ``title_penalty``; ``pattern_hit`` only where a mode asks for it."""
    total = F.col("c") + F.col("t") + F.col("x") + 1e-9
    common = F.col("df_share") >= F.col("df_threshold")
    dominant = (F.col("t") / total >= F.col("dominance")) & (F.col("c") / total <= F.col("low_citation"))
    moulded = F.col("pattern_hit") if "pattern_hit" in rows.columns else F.lit(False)
    return F.when(F.col("mode") == "df_only", common).when(F.col("mode") == "df_plus_dominance", common & dominant).otherwise(common & dominant & moulded)


def title_penalty(rows: DataFrame) -> DataFrame:
    """Titles from common moulds lose ``strength`` where, by ``mode``, the mould is common, the title dominates and
    the citation is weak, and the mould is a listed one. Needs df_share, df_threshold, dominance, low_citation, strength,
    mode; adds triggered."""
    applies = (F.col("source") == "laws_de") & hijacks(rows) & (F.col("t") > 0)
    return rows.withColumn("triggered", applies).withColumn("t", F.when(applies, F.col("t") * F.greatest(F.lit(0.0), 1.0 - F.col("strength"))).otherwise(F.col("t")))


def citation_boost(rows: DataFrame, patterns: Column, families: Column, tokens: Column) -> DataFrame:
    """The citation's score grows with the patterns, the family and the words it shares with the query.

    Needs b_pattern, b_family and b_overlap.
    """
    own = T.citation_tokens("citation")
    family = F.array_contains(families, T.family_or_last("citation")).cast("int")
    shared = F.size(F.array_intersect(tokens, own)) / F.greatest(F.size(own), F.lit(1))
    factor = 1.0 + F.col("b_pattern") * T.pattern_share(patterns, F.col("citation")) + F.col("b_family") * family + F.col("b_overlap") * shared
    return rows.withColumn("c", F.when(F.col("source") == "laws_de", F.col("c") * factor).otherwise(F.col("c")))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every (config, query) by their best field."""
    scored = rows.withColumn("score", F.round(F.greatest("c", "t", "x"), 6))
    order = Window.partitionBy("config_id", "query_id").orderBy(F.desc("score"), "citation", "source")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def grid_recall(gold: DataFrame, hits: DataFrame, grid: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Mean recall of every config at every k, over all queries with gold."""
    found = gold.join(hits.select("config_id", "query_id", "citation", "rank"), ["query_id", "citation"]).groupBy("config_id", "query_id", "citation").agg(F.min("rank").alias("rank"))
    per_query = found.groupBy("config_id", "query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    totals = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    shares = per_query.join(totals, "query_id").groupBy("config_id").agg(*[F.sum(F.col(f"h{k}") / F.col("n")).alias(f"s{k}") for k in ks])
    queries = totals.agg(F.count(F.lit(1)).alias("queries"))
    rows = grid.select("config_id").join(shares, "config_id", "left").crossJoin(F.broadcast(queries))
    return rows.select("config_id", *[F.round(F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / F.col("queries"), 6).alias(f"recall_at_{k}") for k in ks])


def best_config(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Lexicographic best over the metrics, the earliest config among equals."""
    return results.orderBy(*[F.desc(m) for m in metrics], "config_id").limit(1)


def why_it_wins(fp: dict[str, Column], gold: dict[str, Column]) -> Column:
    """What lifts a false positive over gold, by component."""
    return (
        F.when((fp["x"] > F.greatest(fp["c"], fp["t"])) & (fp["x"] > gold["x"] * 1.2), "text_over_power")
        .when((fp["t"] >= fp["x"]) & (fp["t"] > gold["t"] * 1.2), "title_template_too_generic")
        .when(gold["c"] < fp["c"] * 0.7, "citation_signal_too_weak")
        .when((fp["x"] > gold["x"]) | (fp["t"] > gold["t"]) | (fp["c"] > gold["c"]), "mixed_field_advantage")
        .otherwise("no_clear_component_gap")
    )
