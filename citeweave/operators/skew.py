"""Hot keys: found exactly from partial counts, and few by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys can each hold 1/MAX_HOT of all rows, so a table of hot keys is small at every size of input.
MAX_HOT = 1000


def hot_keys(df: DataFrame, key: str, total: int, max_hot: int = MAX_HOT, floor: int = 1000) -> DataFrame:
    """Keys holding at least ``max(floor, total / max_hot)`` rows: one column, at most ``max_hot`` rows, safe to broadcast.

    Counts are combined on the map side, so a key with a third of all rows costs one partial row per task. NULL keys
    are never hot.
    """
    least = max(floor, -(-total // max_hot))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which has each ``key`` once, whatever the skew of ``rows``.

    Lookup rows of hot keys (at most MAX_HOT) are broadcast, so hot rows stay where they are; all others take one
    shuffle by key. ``rows`` should be materialised: it is read twice.
    """
    hot = F.broadcast(hot_keys(rows, key, rows.count() if total is None else total).withColumn("_hot", F.lit(True)))
    tagged = rows.join(hot, key, "left")
    heavy = tagged.where("_hot").drop("_hot").join(F.broadcast(lookup.join(hot, key, "left_semi")), key)
    return heavy.unionByName(tagged.where("_hot IS NULL").drop("_hot").join(lookup, key))
