from __future__ import annotations

import datetime as dt

from citeweave.streaming.ingest import CORPUS_SCHEMA, arrival_counts, corpus_stream, index_stream


def test_index_grows_by_files_and_only_once(spark, tmp_path):
    folder, index, state = (str(tmp_path / n) for n in ("in", "index", "state"))
    first = spark.createDataFrame([("laws_de", 1, "Art. 1 BV", None, "a b a"), ("laws_de", 2, "", None, "lost")], CORPUS_SCHEMA)
    first.write.parquet(folder)
    index_stream(corpus_stream(spark, folder), index, state).awaitTermination()
    assert {(r.term, r.tf) for r in spark.read.parquet(index).where("row_id = 1").collect()} >= {("a", 2), ("b", 1)}
    before = spark.read.parquet(index).count()
    index_stream(corpus_stream(spark, folder), index, state).awaitTermination()
    assert spark.read.parquet(index).count() == before
    spark.createDataFrame([("court_considerations", 3, "BGE 1 I 2", None, "c")], CORPUS_SCHEMA).write.mode("append").parquet(folder)
    index_stream(corpus_stream(spark, folder), index, state).awaitTermination()
    assert spark.read.parquet(index).where("row_id = 3").count() == 5


def test_arrival_counts_of_a_table(spark):
    day = dt.datetime(2031, 3, 1)
    df = spark.createDataFrame([(day, "a"), (day + dt.timedelta(hours=3), "a"), (day + dt.timedelta(days=1), "b"), (None, "a")], "t timestamp, k string")
    assert sorted((r.window_start, r.k, r.n) for r in arrival_counts(df, "t", ["k"]).collect()) == [(day, "a", 2), (day + dt.timedelta(days=1), "b", 1)]
