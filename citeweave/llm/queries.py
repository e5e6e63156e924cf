"""Queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.canon import map_to_reference
from citeweave.llm.chunks import split_oversized
from citeweave.llm.copies import court_key, group_copies, law_key
from citeweave.llm.leaks import leaked_items
from citeweave.llm.packing import pack_documents
from citeweave.llm.pii import find_personal, redact_personal
from citeweave.llm.topn import top_n_per_group
from citeweave.operators.packed_values import split_packed
from citeweave.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best items of every query."""
    items = table(spark, sf_dir, "retrieved_item").where(F.col("query_id").isNotNull())
    return top_n_per_group(items, "query_id", "score", ["citation", "source"], 10).select("query_id", "item_rank", "citation", "source")


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    laws = group_copies(table(spark, sf_dir, "laws_de"), law_key(), "row_id").withColumn("source_table", F.lit("laws_de"))
    court = group_copies(table(spark, sf_dir, "court_considerations"), court_key(), "row_id").withColumn("source_table", F.lit("court_considerations"))
    return laws.unionByName(court)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of an earlier record."""
    return _copies(spark, sf_dir).where("row_id > first_row_id").select("source_table", "first_row_id", "row_id")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with the number of its copies."""
    return _copies(spark, sf_dir).where("row_id = first_row_id").select("source_table", F.col("row_id"), F.col("copies").cast("long").alias("copies"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed citations that are not entries as they stand, with the entry each names, or 0."""
    reference = table(spark, sf_dir, "citation_lookup")
    laws = table(spark, sf_dir, "laws_de").select(F.lit("laws_de").alias("source_table"), "row_id", F.lit(0).alias("pos"), "citation")
    val = split_packed(table(spark, sf_dir, "val"), "gold_citations", ["row_id"], "citation").select(F.lit("val").alias("source_table"), "row_id", "pos", "citation")
    typed = laws.where(F.trim(F.regexp_replace("citation", r"[\s\u00a0]+", " ")) != "").unionByName(val)
    typed = typed.join(reference.select(F.col("canonical_citation").alias("citation")), "citation", "left_anti")
    return map_to_reference(typed, "citation", reference).select("source_table", "row_id", "pos", "canonical_id")


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    laws = table(spark, sf_dir, "laws_de").select(F.lit("laws_de").alias("source_table"), "row_id", "text")
    court = table(spark, sf_dir, "court_considerations").select(F.lit("court_considerations").alias("source_table"), "row_id", "text")
    return split_oversized(laws.unionByName(court), ["source_table", "row_id"], "text", 1200, 150)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over 1,200 characters, and whether cutting them took a hard cut."""
    first = _oversized(spark, sf_dir).where("piece_no = 0")
    return first.select("source_table", "row_id", F.when(F.col("row_hard"), "hard").otherwise("soft").alias("cut_kind"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all texts over 1,200 characters."""
    return _oversized(spark, sf_dir).drop("row_hard")


#: Vocabulary of the public tokenizer that sizes are measured in.
TOKENIZER_FILE = os.environ.get("CITEWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of 2,048 tokens of the byte-level BPE with 50k entries."""
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", 2048, TOKENIZER_FILE)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an evaluation item or at least 15 consecutive words of it."""
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in documents, by type and passage."""
    return find_personal(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with placeholders for the personal information they hold."""
    return redact_personal(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_records": p2_records, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_containers": p6_containers, "p7_found": p7_found, "p8_found": p8_found, "p8_redacted": p8_redacted}

SQL = {
    "p1_found": """
        WITH best AS (
            SELECT query_id, citation, source, max(score) AS score FROM retrieved_item
            WHERE query_id IS NOT NULL AND citation IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation, source) AS item_rank FROM best)
        SELECT query_id, CAST(item_rank AS INTEGER) AS item_rank, citation, source FROM ranked WHERE item_rank <= 10
    """,
    "p5_found": """
        WITH rows AS (
            SELECT 'laws_de' AS source_table, row_id, text FROM laws_de
            UNION ALL SELECT 'court_considerations', row_id, text FROM court_considerations)
        SELECT source_table, row_id,
            CASE WHEN list_max(list_transform(
                regexp_split_to_array(text, '[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]'),
                lambda x: length(x))) > 1200 THEN 'hard' ELSE 'soft' END AS cut_kind
        FROM rows WHERE length(text) > 1200
    """,
}
