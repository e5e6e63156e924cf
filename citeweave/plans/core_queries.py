"""Registered queries of the core library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators.packed_values import split_packed
from citeweave.plans import evaluation_queries, evaluation_sql, extended_queries, pipeline_queries, retrieval_queries, text_queries
from citeweave.runtime import table


def packed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed citation fields of questions and predictions under one shape."""
    val = table(spark, sf_dir, "val").select(F.lit("val").alias("source_table"), "row_id", F.col("gold_citations").alias("field"))
    sub = table(spark, sf_dir, "submission_baseline_v1").select(F.lit("submission_baseline_v1").alias("source_table"), "row_id", F.col("predicted_citations").alias("field"))
    return val.unionByName(sub)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per citation typed into a packed field, with its position."""
    return split_packed(packed_fields(spark, sf_dir), "field", ["source_table", "row_id"], "citation")


QUERIES = {"p3_found": p3_found} | text_queries.QUERIES | retrieval_queries.QUERIES | evaluation_queries.QUERIES | extended_queries.QUERIES | pipeline_queries.QUERIES
SQL: dict[str, str] = {} | text_queries.SQL | retrieval_queries.SQL | evaluation_sql.SQL | extended_queries.SQL | pipeline_queries.SQL
