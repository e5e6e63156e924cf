"""Files in and out: declared schemas, no inference, ranks as columns until the sink."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.functions import text as X
from citeweave.runtime import cut_lineage, shuffle_partitions

SCHEMAS = {
    "questions": ("query_id", "query", "gold_citations"),
    "test_questions": ("query_id", "query"),
    "predictions": ("query_id", "predicted_citations"),
    "laws": ("citation", "text", "title"),
    "court": ("citation", "text"),
    "lookup": ("norm_citation", "canonical_citation"),
    "title_rules": ("title_template_or_pattern", "suggested_penalty_type"),
    "router_candidates": ("query_id", "should_route_first"),
}


def read_csv(spark: SparkSession, path: str, kind: str | Iterable[str], limit: int | None = None) -> DataFrame:
    """A CSV file with a header, all columns strings; quoted line breaks and a byte order mark are fine."""
    names = SCHEMAS[kind] if isinstance(kind, str) else tuple(kind)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=True)
    rows = rows.withColumn(names[0], F.regexp_replace(names[0], "^﻿", ""))
    return rows.limit(limit) if limit is not None else rows


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """query_id, rank, citation; blank ids skipped, repeated citations kept once."""
    rows = read_csv(spark, path, "predictions").where(F.trim("query_id") != "")
    return rows.select(F.trim("query_id").alias("query_id"), F.posexplode(F.array_distinct(X.split_citations("predicted_citations"))).alias("rank", "citation")).withColumn("rank", F.col("rank") + 1)


def joined_predictions(ranked: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Ranked rows as one semicolon list a query; queries without a row get an empty list."""
    lists = ranked.groupBy("query_id").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda s: s["citation"])).alias("predicted_citations"))
    if queries is None:
        return lists
    return queries.select("query_id").join(lists, "query_id", "left").fillna("", ["predicted_citations"])


def write_predictions(ranked: DataFrame, path: str, queries: DataFrame | None = None, files: int | None = None) -> None:
    """Sorted by query_id over all files, one line a query; as many files as tasks, unless ``files`` says how many."""
    lines = joined_predictions(ranked, queries)
    lines = lines.orderBy("query_id") if files is None else lines.repartitionByRange(files, "query_id").sortWithinPartitions("query_id")
    lines.write.mode("overwrite").csv(path, header=True, escape='"')


def write_summary(rows: DataFrame, path: str) -> None:
    """A summary of one row as one JSON object."""
    rows.limit(1).write.mode("overwrite").json(path)


def read_triplets(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Training examples from JSON lines: query, positive_text, negative_text."""
    rows = spark.read.schema("query_id string, query string, positive_text string, negative_text string").json(path)
    return rows.limit(limit) if limit is not None else rows


def write_rows(rows: DataFrame, path: str, form: str = "parquet", partition_by: str | None = None) -> None:
    """Any table as parquet, csv (arrays joined by semicolons) or json lines."""
    if form == "csv":
        rows = rows.select(*[F.concat_ws(";", c).alias(c) if isinstance(rows.schema[c].dataType, T.ArrayType) else F.col(c) for c in rows.columns])
    writer = rows.write.mode("overwrite")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.csv(p, header=True, escape='"')}[form](path)


def with_row_ids(rows: DataFrame, *order: str) -> DataFrame:
    """row_id from 0 within every source, in the given order; a source takes as many tasks as its range needs."""
    named = rows.withColumn("list_id", F.col("source"))
    spread = cut_lineage(named.repartitionByRange(shuffle_partitions(rows.sparkSession), "list_id", *order).withColumn("_p", F.spark_partition_id()))
    counts = spread.groupBy("list_id", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("list_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("list_id", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = spread.withColumn("_r", F.row_number().over(Window.partitionBy("list_id", "_p").orderBy(*order)))
    return local.join(counts, ["list_id", "_p"]).withColumn("row_id", (F.col("_r") + F.col("_before") - 1).cast("int")).drop("list_id", "_p", "_r", "_before")


def read_json(path: str) -> dict:
    """A configuration file; a missing one is empty."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def title_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Exact title templates and title patterns; patterns that do not compile are left out."""
    import re

    def compiles(p: str | None) -> bool:
        try:
            re.compile(p or "")
            return bool(p)
        except re.error:
            return False

    rows = read_csv(spark, path, "title_rules").where(F.trim("title_template_or_pattern") != "")
    patterns = rows.where("suggested_penalty_type = 'regex_title_penalty'").where(F.udf(compiles, "boolean")("title_template_or_pattern"))
    return rows.where("suggested_penalty_type IS DISTINCT FROM 'regex_title_penalty'").select(F.col("title_template_or_pattern").alias("template")), patterns.select(F.col("title_template_or_pattern").alias("pattern"))


def preflight(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Findings (check, n): missing and unknown ids, repeated ids, empty lists, repeated citations in a list."""
    ids = predictions.select("query_id")
    cited = X.split_citations("predicted_citations")
    checks = {
        "missing_id": expected.select("query_id").join(ids, "query_id", "left_anti"),
        "unknown_id": ids.join(expected.select("query_id"), "query_id", "left_anti"),
        "repeated_id": ids.groupBy("query_id").count().where("count > 1"),
        "empty_list": predictions.where(F.size(cited) == 0),
        "repeated_citation": predictions.where(F.size(cited) != F.size(F.array_distinct(cited))),
    }
    out = None
    for name, rows in checks.items():
        row = rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
