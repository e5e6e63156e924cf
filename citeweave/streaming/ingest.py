"""Chunked reading of large corpora as a stream of files: each micro-batch is indexed and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeweave.functions import text as T
from citeweave.operators.sparse import postings

CORPUS_SCHEMA = "source string, row_id bigint, citation string, title string, text string"


def corpus_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """New parquet files of a corpus folder, a bounded number a batch, normalised as they arrive."""
    rows = spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.fillna("", ["citation", "title", "text"]).withColumn("norm", T.normalize_citation("citation"))


def index_stream(rows: DataFrame, index_path: str, state_path: str) -> StreamingQuery:
    """Postings of every arriving document, appended by source; exactly once by the stream's own log.

    Documents are complete within a batch, so no state is kept between batches. Read the folder like any table.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        body = T.joined(F.col("norm"), F.col("title"), F.col("text"))
        index = postings(batch.where("norm <> ''"), body, ["source", "row_id"]).withColumn("batch", F.lit(batch_id))
        index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(index_path)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", state_path).trigger(availableNow=True).start()


def arrival_counts(rows: DataFrame, time: str, keys: list[str], window: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """Rows by window of their time, late rows admitted up to ``lateness``; works on streams and on tables."""
    timed = rows.where(F.col(time).isNotNull())
    timed = timed.withWatermark(time, lateness) if rows.isStreaming else timed
    counts = timed.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *keys, "n")
