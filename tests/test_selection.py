from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.operators import evaluate as E
from citeweave.operators import grid as G
from citeweave.operators import rerank as RR
from citeweave.sources import files


def reranked(spark, scores):
    return spark.createDataFrame([("q", f"c{i}", s, i + 1) for i, s in enumerate(scores)], "query_id string, citation string, rerank_score double, rerank_rank int")


def kept(df):
    return [r.rerank_rank for r in df.orderBy("rerank_rank").collect()]


def test_cuts(spark):
    assert kept(RR.cut(reranked(spark, [10.0, 8.6, 8.4]), "relative", 5)) == [1, 2]
    assert kept(RR.cut(reranked(spark, [-1.0, -2.0]), "relative", 1)) == [1]
    assert kept(RR.cut(reranked(spark, [3.0, 2.0, 1.0]), "score", 2, threshold=99)) == [1, 2]
    assert kept(RR.cut(reranked(spark, [3.0, 2.0, 1.0]), "nonsense", 2)) == [1, 2]
    assert kept(RR.cut(reranked(spark, [1.0]).where("false"), "relative", 2)) == []


def test_token_overlap(spark):
    df = spark.createDataFrame([("q", "a b c", "b c d", "laws_de", 0.02)], "query_id string, query string, body string, source string, fused_score double")
    assert RR.token_overlap(df).first().rerank_score == 0.065


def test_calibration_moves_only_the_head(spark):
    rows = [("q", "a", "laws_de", 1.0, 1, 0, 0, 0, 0, 1), ("q", "b", "laws_de", 0.95, 2, 1, 1, 0, 0, 0), ("q", "c", "laws_de", 0.1, 3, 1, 1, 1, 1, 0)]
    df = spark.createDataFrame(rows, "query_id string, citation string, source string, rerank_score double, rerank_rank int, is_rule int, is_family int, is_issue int, is_both int, is_dense_only int")
    got = {r.citation: (r.calibrated_score, r.calibrated_rank) for r in RR.calibrate(df, 2).collect()}
    assert got == {"a": (0.96, 2), "b": (1.1, 1), "c": (0.1, 3)}


def test_f1_both_definitions_of_empty(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    gold = spark.createDataFrame([("a", "A"), ("a", "B")], "query_id string, citation string")
    pred = spark.createDataFrame([("a", "B"), ("a", "C"), ("z", "B")], "query_id string, citation string")
    got = {r.query_id: (r.tp, r.fp, r.fn, r.f1) for r in E.per_query_f1(queries, gold, pred).collect()}
    assert got == {"a": (1, 1, 1, 0.5), "b": (0, 0, 0, 0.0), "c": (0, 0, 0, 0.0)}
    assert {r.query_id: r.f1 for r in E.per_query_f1(queries, gold, pred, empty=1.0).collect()}["b"] == 1.0
    again = E.per_query_f1(queries, gold, pred).select("query_id", F.col("f1").alias("g")).join(E.per_query_f1(queries, gold.distinct(), pred.distinct()), "query_id")
    assert again.count() == len(again.collect()) == 3


def test_nearest_rank_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    assert [E.nearest_rank_quantile(df, "v", q).first().threshold for q in (0.5, 0.9)] == [2.0, 4.0]
    assert E.nearest_rank_quantile(df.where("false"), "v", 0.5).first().threshold == 1.0


def test_ordered_union_and_shaping(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, citation string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, citation string, rank int")
    assert [r.citation for r in RR.ordered_union(a, b).orderBy("rank").collect()] == ["x", "y", "z"]
    pool = spark.createDataFrame([("q", f"c{i}", 1, int(i == 5), 0, 0, i + 1, 0.0) for i in range(6)], "query_id string, citation string, is_laws int, is_rule int, is_family int, is_issue int, fused_rank int, pool_score double")
    assert [r.citation for r in RR.shape_input(pool, 4, 4).orderBy("input_rank").collect()] == ["c5", "c0", "c1", "c2"]


def test_grid_size_and_best(spark):
    grid = G.configs(spark, a=[1.0, 2.0], b=["x", "y", "z"])
    assert grid.count() == 6
    results = spark.createDataFrame([(0, 0.5, 0.1), (1, 0.5, 0.2), (2, 0.5, 0.2)], "config_id int, m double, n double")
    assert G.best_config(results, ["m", "n"]).first().config_id == 1


def test_files_round_trip(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text('﻿query_id,predicted_citations\nq2,"Art. 1 BV;Art. 1 BV;Art. 2 BV"\n ,x\nq1,"a ""b""\nc"\n', encoding="utf-8")
    got = files.read_predictions(spark, str(source))
    assert [(r.query_id, r["rank"], r.citation) for r in got.orderBy("query_id", "rank").collect()] == [("q1", 1, 'a "b" c'), ("q2", 1, "Art. 1 BV"), ("q2", 2, "Art. 2 BV")]
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")
    files.write_predictions(got, str(tmp_path / "out"), queries)
    back = files.read_csv(spark, str(tmp_path / "out"), "predictions").orderBy("query_id").collect()
    assert [(r.query_id, r.predicted_citations or "") for r in back] == [("q1", 'a "b" c'), ("q2", "Art. 1 BV;Art. 2 BV"), ("q3", "")]
    checks = {r.check: r.n for r in files.preflight(files.read_csv(spark, str(source), "predictions"), queries).collect()}
    assert checks["missing_id"] == 1 and checks["unknown_id"] == 1 and checks["repeated_citation"] == 1
    assert files.read_json(str(tmp_path / "none.json")) == {}


def test_title_rules_skip_bad_patterns(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("title_template_or_pattern,suggested_penalty_type\nverordnung,exact\n^ges.*,regex_title_penalty\n(,regex_title_penalty\n", encoding="utf-8")
    exact, patterns = files.title_rules(spark, str(path))
    assert [r.template for r in exact.collect()] == ["verordnung"] and [r.pattern for r in patterns.collect()] == ["^ges.*"]
