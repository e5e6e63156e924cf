"""Duplicates hidden by formatting differences: canonical keys, hot keys in two levels, the rest in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators.skew import hot_keys
from citeweave.runtime import cut_lineage

#: Marks the borders of a number, so that 6.2 and 62 stay apart; canonical text holds it nowhere else.
BORDER = "\u0001"
#: Punctuation, white space, control and format characters.
NOISE = r"[\p{P}\p{Z}\p{C}&&[^\u0001]]+"

#: Parts of a citation, longest kind first: docket number, reporter with volume, division and page, recital,
#: collection number, label with number, section sign with number, any other word or number.
PARTS = (
    r"\d+[a-z][\W_]{0,3}\d+/\d{4}"
    r"|(?:bge|atf|dtf)[\W_]*\d+[\W_]*[ivx]+[\W_]*\d+"
    r"|(?<![\p{L}\p{N}])(?:e|erw|erwägung|consid|c)[\W_]*\d+(?:\.\d+)*"
    r"|sr[\W_]*\d+(?:\.\d+)*"
    r"|(?:[\p{L}\p{M}]+|§)[\W_]*\d+(?:[\W_]{0,2}(?:bis|ter|quater)(?![\p{L}])|[a-z](?=abs|[^\p{L}]|$))?"
    r"|\d+(?:\.\d+)+"
    r"|[\p{L}\p{M}]+|[\p{N}]+|[\p{S}\p{M}]+"
)


def fold(text: Column) -> Column:
    """Letter case away, by way of upper case, so that all small letters of one capital agree; ß and SS agree."""
    return F.lower(F.upper(F.replace(text, F.lit("ß"), F.lit("SS"))))


def canonical_text(text: Column) -> Column:
    """Equal for texts that differ only in white space, letter case and punctuation; numbers keep their borders."""
    # A mark that stands in the text already is white space there.
    marked = F.regexp_replace(F.translate(fold(text), BORDER, " "), r"(\p{N}+)", f"{BORDER}$1{BORDER}")
    return F.coalesce(F.regexp_replace(marked, NOISE, ""), F.lit(""))


def canonical_citation(citation: Column) -> Column:
    """As ``canonical_text``, and free of the order of the parts; a number stays with its label."""
    parts = F.regexp_extract_all(fold(citation), F.lit("(?U)" + PARTS), 0)
    return F.coalesce(F.array_join(F.array_sort(F.transform(parts, canonical_text)), "\u0002"), F.lit(""))


def canonical_key(*columns: Column) -> Column:
    """128 bits of the canonical columns."""
    return F.unhex(F.md5(F.concat_ws("\u0003", *columns)))


def group_copies(df: DataFrame, key: Column, row_id: str, salts: int = 64) -> DataFrame:
    """Every row with the group it belongs to: ``first_row_id`` (least of the group), ``copies``, ``row_id``.

    Keys are counted once (combined on the map side) to find the hot ones exactly. A hot key is aggregated in two
    levels, first by (key, salt), then by key, and its result reaches its rows by a broadcast of at most MAX_HOT rows,
    so hot rows are never shuffled whole. All other keys take one shuffle by key.

    Cases: a NULL row_id is no row; repeated rows (same row_id) count each; NULL and blank parts of a key agree (see
    ``canonical_text``); rows with all parts blank form one group; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = cut_lineage(df.select(key.alias("_key"), F.col(row_id).alias("row_id")).where(F.col("row_id").isNotNull()))
    hot = F.broadcast(hot_keys(rows, "_key", rows.count()).withColumn("_hot", F.lit(True)))
    tagged = rows.join(hot, "_key", "left")
    cold = tagged.where("_hot IS NULL").groupBy("_key").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("copies"))
    cold = tagged.where("_hot IS NULL").select("_key", "row_id").join(cold.where("copies > 1"), "_key", "left")
    cold = cold.select(F.coalesce("first_row_id", "row_id").alias("first_row_id"), F.coalesce("copies", F.lit(1)).alias("copies"), "row_id")
    heavy = tagged.where("_hot").withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
    level = heavy.groupBy("_key", "_salt").agg(F.min("row_id").alias("_min"), F.count(F.lit(1)).alias("_n"))
    level = level.groupBy("_key").agg(F.min("_min").alias("first_row_id"), F.sum("_n").alias("copies"))
    heavy = heavy.select("_key", "row_id").join(F.broadcast(level), "_key").select("first_row_id", "copies", "row_id")
    return cold.unionByName(heavy)


def law_key(row_citation: str = "citation", text: str = "text", title: str = "title") -> Column:
    return canonical_key(canonical_citation(F.col(row_citation)), canonical_text(F.col(text)), canonical_text(F.col(title)))


def court_key(row_citation: str = "citation", text: str = "text") -> Column:
    return canonical_key(canonical_citation(F.col(row_citation)), canonical_text(F.col(text)))
