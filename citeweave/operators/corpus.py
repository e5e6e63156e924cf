"""The corpus, its questions and what is derived from them once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.runtime import table

LAWS, COURT = "laws_de", "court_considerations"


def corpus(spark: SparkSession, sf_dir: str, laws_rows: int | None = None, court_rows: int | None = None) -> DataFrame:
    """Both sources under one shape: source, row_id, citation, norm, title, text; NULLs become ''.

    A row limit of a source keeps its first rows by row_id; 0 leaves the source out.
    """
    laws, court = table(spark, sf_dir, LAWS), table(spark, sf_dir, COURT)
    parts = []
    for source, rows, limit in ((LAWS, laws, laws_rows), (COURT, court.withColumn("title", F.lit("")), court_rows)):
        if limit == 0:
            continue
        rows = rows.select(F.lit(source).alias("source"), "row_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("citation", "title", "text")])
        if limit is not None:
            rows = rows.orderBy("row_id").limit(limit)
        parts.append(rows)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("norm", T.normalize_citation("citation"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per query_id, the last one sent: query_id, row_id, query, gold (list as typed)."""
    last = Window.partitionBy("query_id").orderBy(F.desc("row_id"))
    rows = table(spark, sf_dir, "val").where("query_id IS NOT NULL").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.select("query_id", "row_id", F.trim(F.coalesce("query", F.lit(""))).alias("query"), F.col("gold_citations").alias("gold"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct normalised gold citations of every query: query_id, citation."""
    rows = questions(spark, sf_dir).select("query_id", F.explode(T.split_citations("gold")).alias("citation"))
    return rows.distinct()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final predictions of the last trace of every query, as ranked rows: query_id, rank (from 1), citation."""
    last = Window.partitionBy("query_id").orderBy(F.desc("row_id"))
    rows = table(spark, sf_dir, "val_seed_trace_silver_baseline_v0").where("query_id IS NOT NULL").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.select("query_id", F.posexplode(F.array_distinct(T.split_citations("final_predictions"))).alias("rank", "citation")).withColumn("rank", F.col("rank") + 1)


def candidates(spark: SparkSession, sf_dir: str, column: str = "fused_top200") -> DataFrame:
    """A ranked list of the last trace of every query: query_id, rank, citation (first occurrences)."""
    last = Window.partitionBy("query_id").orderBy(F.desc("row_id"))
    rows = table(spark, sf_dir, "val_seed_trace_silver_baseline_v0").where("query_id IS NOT NULL").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.select("query_id", F.posexplode(F.array_distinct(T.split_citations(column))).alias("rank", "citation")).withColumn("rank", F.col("rank") + 1)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored hits of all branches: query_id, list_id (method), source, citation, score; unusable rows left out."""
    rows = table(spark, sf_dir, "retrieved_item").where("query_id IS NOT NULL AND citation IS NOT NULL AND method IS NOT NULL AND source IS NOT NULL")
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return rows.groupBy("query_id", F.col("method").alias("list_id"), "source", "citation").agg(F.max("score").alias("score"))


def fields_of(rows: DataFrame) -> DataFrame:
    """One row per field of a corpus row, with its text as body; decisions have no title."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("body")) for f, c in (("citation", "norm"), ("title", "title"), ("text", "text"))])
    rows = rows.select("source", "row_id", F.col("norm").alias("citation"), F.explode(fields).alias("f")).select("source", "f.field", "row_id", "citation", "f.body")
    return rows.where("NOT (source = 'court_considerations' AND field = 'title')")


def citation_lookup(rows: DataFrame) -> DataFrame:
    """The shortest, then least spelling of every normalised citation."""
    spelt = rows.where("norm <> ''").groupBy("norm").agg(F.min(F.struct(F.length("citation"), F.col("citation"))).alias("m"), F.count(F.lit(1)).alias("n_rows"))
    return spelt.select("norm", F.col("m.citation").alias("canonical"), "n_rows")


def source_map(rows: DataFrame) -> DataFrame:
    """Raw and normalised citation to source; the later row wins, court after laws."""
    both = rows.select("source", "row_id", F.explode(F.array("citation", "norm")).alias("citation"))
    order = F.struct((F.col("source") == COURT).cast("int").alias("o"), F.col("row_id"))
    return both.groupBy("citation").agg(F.max_by("source", order).alias("source"))


def doc_lookup(rows: DataFrame) -> DataFrame:
    """The row that stands for a normalised citation; the later row wins, court after laws."""
    order = F.struct((F.col("source") == COURT).cast("int").alias("o"), F.col("row_id"))
    chosen = rows.where("norm <> ''").groupBy("norm").agg(F.max_by(F.struct("source", "row_id"), order).alias("d")).select("norm", "d.*")
    return chosen.join(rows.select("source", "row_id", "title", "text"), ["source", "row_id"]).select("norm", "source", "row_id", "title", "text")


def first_rows(rows: DataFrame) -> DataFrame:
    """M4: the first row of every normalised citation: norm, row_id."""
    return rows.where("norm <> ''").groupBy("norm").agg(F.min("row_id").alias("row_id"))


def corpus_stats(rows: DataFrame) -> DataFrame:
    """Rows, non-empty citations and distinct normalised citations by source."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("norm") != "").alias("n_cited"), F.countDistinct(F.nullif("norm", F.lit(""))).alias("n_distinct"))


def resolve(citations: DataFrame, lookup: DataFrame) -> DataFrame:
    """Citations under their canonical form where the lookup has one."""
    names = lookup.select(F.col("norm").alias("citation"), "canonical")
    return citations.join(names, "citation", "left").withColumn("citation", F.coalesce("canonical", "citation")).drop("canonical")
