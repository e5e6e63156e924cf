from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeweave.operators import dense as D
from citeweave.operators import fusion as FU
from citeweave.operators import rules as R
from citeweave.operators import sparse as SP


def bm25(docs, query):
    words = [re.findall(r"[^\W_]+", d.lower()) for d in docs]
    n, avg = len(docs), sum(map(len, words)) / len(docs)
    df = Counter(t for w in words for t in set(w))
    out = []
    for w in words:
        tf, s = Counter(w), 0.0
        for t in re.findall(r"[^\W_]+", query.lower()):
            if tf[t]:
                s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / (avg + 1e-9)) + 1e-9)
        out.append(s)
    return out


def search(spark, docs, queries):
    d = spark.createDataFrame([("a", i, t) for i, t in enumerate(docs)], "g string, id int, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "q int, text string")
    rows = SP.bm25(d, F.col("text"), ["g", "id"], ["g"], q, "q", F.col("text")).collect()
    return {(r.q, r.id): r.score for r in rows}


def test_bm25_counts_repeated_query_words(spark):
    assert search(spark, ["a b", "b"], ["b b"]) == {(0, 0): 0.317081, (0, 1): 0.428992}


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    docs = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 9))) for _ in range(25)]
    queries = [" ".join(rng.choices("abcdefghz", k=4)) for _ in range(6)] + ["", "zz"]
    got = search(spark, docs, queries)
    for i, q in enumerate(queries):
        for j, s in enumerate(bm25(docs, q)):
            assert got.get((i, j), 0.0) == pytest.approx(s, abs=1e-6)


@pytest.mark.parametrize("most", [SP.MOST_TERMS, 0])
def test_search_keeps_the_best_of_every_query_and_group(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(SP, "MOST_TERMS", most)
    rng = random.Random(4)
    docs = [(g, i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 9)))) for g in "xy" for i in range(40)] + [("x", 90, None), ("x", 91, "")]
    d = spark.createDataFrame(docs, "g string, id int, t string").repartition(7)
    queries = [(i, " ".join(rng.choices("abcdefghz", k=4)), 0.9) for i in range(5)] + [(8, "", 1.0), (9, "zz", 1.0), (10, None, 1.0)]
    q = spark.createDataFrame(queries, "q int, t string, w double")
    expected = []
    for i, t, _ in queries:
        for g in "xy":
            mine = [(n, x or "") for h, n, x in docs if h == g]
            scored = sorted((-round(s, 6), n) for (n, _), s in zip(mine, bm25([x for _, x in mine], t or "")) if s > 0)
            expected += [(i, g, n, -s, r) for r, (s, n) in enumerate(scored[:6], 1)]
    expected.sort()
    got = SP.search(d, F.col("t"), ["g"], ["id"], q, "q", F.col("t"), 6)
    assert sorted((r.q, r.g, r.id, r.score, r["rank"]) for r in got.collect()) == expected
    boosted = SP.search(d, F.col("t"), ["g"], ["id"], q, "q", F.col("t"), 6, per_group=False, boost="w", carry=("t",))
    best = {i: sorted((-math.floor(s * 0.9 * 1e6 + 0.5) / 1e6, g, n) for j, g, n, s, _ in expected if j == i)[:6] for i in range(5)}
    assert sorted((r.q, -r.score, r.g, r.id) for r in boosted.collect()) == sorted((i, *x) for i, rows in best.items() for x in rows)
    assert SP.search(d.where("false"), F.col("t"), ["g"], ["id"], q, "q", F.col("t"), 6).count() == 0
    SP.save_index(d, F.col("t"), ["g"], ["id"], str(tmp_path / "index"))
    stored = SP.search_index(spark, str(tmp_path / "index"), ["g"], ["id"], q, "q", F.col("t"), 6)
    assert sorted((r.q, r.g, r.id, r.score, r["rank"]) for r in stored.collect()) == expected


def test_search_shuffles_no_terms_and_no_pairs(spark):
    d = spark.createDataFrame([("a", 1, "x y"), ("a", 2, "y")], "g string, id int, t string")
    q = spark.createDataFrame([(1, "x")], "q int, t string")
    plan = SP.search(d, F.col("t"), ["g"], ["id"], q, "q", F.col("t"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") > plan.index("Exchange")


def test_stored_search_shuffles_no_pairs(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, "x y"), ("a", 2, "y")], "g string, id int, t string")
    q = spark.createDataFrame([(1, "x")], "q int, t string")
    SP.save_index(d, F.col("t"), ["g"], ["id"], str(tmp_path))
    plan = SP.search_index(spark, str(tmp_path), ["g"], ["id"], q, "q", F.col("t"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan and plan.index("MapInArrow") > plan.index("Exchange")


@pytest.mark.parametrize("most", [SP.MOST_TERMS, 0])
def test_stored_search_over_many_blocks(spark, monkeypatch, tmp_path, most):
    """Blocks of some 40 tokens, equal scores in different blocks, two keys, more than 1,000 query terms, a long document."""
    monkeypatch.setattr(SP, "MOST_TERMS", most)
    rng = random.Random(5)
    words = ["the", "of"] * 200 + ["äpfel", "éa", "z9", "10"] * 9 + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)] * 4 + ["w1 the " * 90, None, "", "- ."]
    docs = [("xy"[i % 2], None if i == 7 else f"k{i % 50}", i, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    d = spark.createDataFrame(docs, "g string, a string, b bigint, t string").repartition(3)
    queries = [(f"q{i}", " ".join(rng.choices(words, k=6))) for i in range(9)] + [("many", " ".join(f"w{i}" for i in range(1200))), ("none", "v"), ("empty", None)]
    q = spark.createDataFrame(queries, "q string, t string")
    expected = []
    for i, t in queries:
        for g in "xy":
            mine = [(a or "", b, x or "") for h, a, b, x in docs if h == g]
            scored = sorted((-round(s, 6), a, b) for (a, b, _), s in zip(mine, bm25([x for *_, x in mine], t or "")) if s > 0)
            expected += [(i, g, a, b, -s, r) for r, (s, a, b) in enumerate(scored[:7], 1)]
    SP.save_index(d, F.col("t"), ["g"], ["a", "b"], str(tmp_path), 40)
    assert spark.read.parquet(f"{tmp_path}/postings").select("_block").distinct().count() > 20
    got = SP.search_index(spark, str(tmp_path), ["g"], ["a", "b"], q, "q", F.col("t"), 7)
    assert sorted((r.q, r.g, r.a or "", r.b, r.score, r["rank"]) for r in got.collect()) == sorted(expected)
    stats = ["g", "term", "df", "n", "avgdl", "idf"]
    whole = SP.term_stats(d, F.col("t"), ["g"]).select(*stats)
    assert sorted(spark.read.parquet(f"{tmp_path}/terms").select(*stats).collect()) == sorted(whole.collect())
    SP.save_index(d.where("false"), F.col("t"), ["g"], ["a", "b"], str(tmp_path))
    assert SP.search_index(spark, str(tmp_path), ["g"], ["a", "b"], q, "q", F.col("t"), 7).count() == 0


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id string, list_id string, source string, citation string, rank int, score double")


def ranked(df, column="citation"):
    return [(r[column], r.score) for r in df.orderBy("rank").collect()]


def test_reciprocal_rank(spark):
    rows = [("q", "1", "laws_de", "a", 1, 0.0), ("q", "1", "laws_de", "b", 2, 0.0), ("q", "2", "laws_de", "b", 1, 0.0), ("q", "2", "laws_de", "c", 2, 0.0)]
    assert ranked(FU.reciprocal_rank(lists(spark, rows), 9)) == [("b", round(1 / 62 + 1 / 61, 6)), ("a", round(1 / 61, 6)), ("c", round(1 / 62, 6))]
    twice = [("q", "1", "laws_de", "a", 1, 0.0), ("q", "1", "laws_de", "a", 2, 0.0)]
    assert ranked(FU.reciprocal_rank(lists(spark, twice), 9)) == [("a", round(1 / 61 + 1 / 62, 6))]


def test_min_max_singleton_gives_nothing(spark):
    rows = [("q", "1", "laws_de", "a", 1, 2.0), ("q", "1", "laws_de", "b", 2, 1.0), ("q", "2", "laws_de", "b", 1, 5.0)]
    assert ranked(FU.min_max(lists(spark, rows), {"1": 0.6, "2": 0.4}, 9)) == [("a", 0.6), ("b", 0.0)]
    with pytest.raises(ValueError):
        FU.min_max(lists(spark, rows), {}, 9)


def test_family_constraint_needs_enough_matches(spark):
    def rows(n):
        return spark.createDataFrame([("q", f"Art. {i} {'ZGB' if i < n else 'OR'}", ["ZGB"]) for i in range(8)], "query_id string, citation string, families array<string>")

    assert FU.family_constrain(rows(5), 5).count() == 5
    assert FU.family_constrain(rows(4), 5).count() == 8
    assert FU.family_constrain(rows(8).withColumn("families", F.array().cast("array<string>")), 5).count() == 8


def test_rules(spark):
    corpus = spark.createDataFrame(
        [("laws_de", "Art. 221 Abs. 1 StPO", "Art. 221 Abs. 1 StPO"), ("laws_de", "Art. 22 OR", "Art. 22 OR"), ("court_considerations", "BGE 137 IV 122 E. 6.2", "BGE 137 IV 122 E. 6.2"), ("court_considerations", "BGE 137 IV 122 E. 7", "BGE 137 IV 122 E. 7")],
        "source string, citation string, norm string",
    )
    queries = spark.createDataFrame([("a", "see Art. 221 Abs. 1 StPO"), ("b", "BGE 137 IV 122 applies"), ("c", "Art. 22 alone"), ("d", "none")], "query_id string, query string")
    got = {(r.query_id, r.citation, r.method) for r in R.search(queries, corpus, 10, 10).collect()}
    assert got == {("a", "Art. 221 Abs. 1 StPO", "rule_exact"), ("b", "BGE 137 IV 122 E. 6.2", "rule_prefix"), ("b", "BGE 137 IV 122 E. 7", "rule_prefix")}
    assert {r.source for r in R.search(queries, corpus, 10, 0).collect()} == {"laws_de"}


def test_rules_find_short_beginnings_and_what_stands_inside(spark):
    corpus = spark.createDataFrame(
        [("court_considerations", 1, "Art. 5 Abs. 2 BV", "Art. 5 Abs. 2 BV"), ("court_considerations", 2, "Urteil 5A_123/2020 vom 1.1.2020", "Urteil 5A_123/2020 vom 1.1.2020"), ("court_considerations", 3, "Urteil 5A_123/2021", "Urteil 5A_123/2021"), ("court_considerations", 4, "ATF vgl. BGE  137 IV122", "ATF vgl. BGE 137 IV122"), ("laws_de", 5, "Art.5 ZGB", "Art.5 ZGB"), ("laws_de", 6, "art.5 zgb", "art.5 zgb"), ("laws_de", 7, None, "")],
        "source string, row_id long, citation string, norm string",
    )
    queries = spark.createDataFrame([("a", "Art. 5"), ("b", "5A_123/2020 E. 3 und 5A_123/2020"), ("c", "Art.5 ZGB"), ("d", None)], "query_id string, query string")
    got = {(r.query_id, r.citation, r.method) for r in R.search(queries, corpus, 10, 10).collect()}
    assert ("a", "Art. 5 Abs. 2 BV", "rule_prefix") in got and ("c", "art.5 zgb", "rule_exact") in got and ("c", "Art.5 ZGB", "rule_prefix") in got
    assert not [g for g in got if "5A_123/2021" in g[1]] and R.search(queries.where("query_id = 'd'"), corpus, 10, 10).count() == 0


def test_relaxed_patterns_meet_what_the_expression_matches(spark):
    rng = random.Random(8)
    parts = ["bge", "137", "iv", "12", "1", "art.", "5", "a_1/2", "e.", "."]
    texts = sorted({"".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 6))).strip() for _ in range(300)} - {""})
    wanted = sorted({" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(60)} - {"."})
    docs = spark.createDataFrame([(t,) for t in texts], "norm string")
    patterns = spark.createDataFrame([(w,) for w in wanted], "pattern string")
    got = {(r.pattern, r.norm) for r in R._inside(patterns, docs).collect()}
    expression = {w: re.compile(re.escape(w).replace(r"\ ", r"\s+").replace(r"\.", r"\.?\s*")) for w in wanted}
    assert got == {(w, t) for w in wanted for t in texts if expression[w].search(t)} and len(got) > 100
    starts = {(r.pattern, r.norm) for r in R._starts(patterns, docs).collect()}
    assert starts == {(w, t) for w in wanted for t in texts if t.startswith(w)}


def test_dense_against_brute_force(spark):
    rng = random.Random(1)
    vectors = [(i, "laws_de" if i % 2 else "court_considerations", [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)] + [(60, "laws_de", None)]
    corpus = spark.createDataFrame(vectors, "id long, source string, embedding array<float>")
    probes = corpus.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    got = D.dense_top_k(corpus, probes, 5).collect()
    import numpy as np

    by_id = {i: np.array(v, dtype=np.float32).astype(float) for i, _, v in vectors if v}
    for q in range(3):
        for source in ("laws_de", "court_considerations"):
            best = sorted(((-round(float(by_id[q] @ by_id[i]), 6), i) for i, s, v in vectors if s == source and v))[:5]
            assert sorted((-r.score, r.id) for r in got if r.query_id == q and r.source == source) == best


def test_hashed_vectors_have_unit_length(spark):
    rows = spark.createDataFrame([(1, "ein Gesetz"), (2, "")], "id int, t string")
    got = {r.id: r.embedding for r in D.hashed_vectors(rows, "id", F.col("t"), dims=16).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1.0) and not any(got[2])
