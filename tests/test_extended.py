from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeweave import runtime
from citeweave.functions import text as T
from citeweave.operators import dense as D
from citeweave.operators import evaluate as E
from citeweave.operators import fusion as FU
from citeweave.operators import grid as G
from citeweave.operators import mining as M
from citeweave.operators import rerank as RR
from citeweave.operators import rules as R
from citeweave.operators import sparse as SP
from citeweave.plans import pipeline as P
from citeweave.sources import files
from tests import oracle


def test_families_and_citations_by_their_words(spark):
    rows = [("under the Criminal Procedure Code and Art. 41 OR", ["OR", "STPO"]), ("the civil code, zgb", ["ZGB"]), ("organ", []), (None, [])]
    df = spark.createDataFrame([(q,) for q, _ in rows], "q string")
    assert [r.f for r in df.select(T.explicit_families("q").alias("f")).collect()] == [f for _, f in rows]
    texts = spark.createDataFrame([("Art. 221 Abs. 1 lit. b StPO und Art. 5  Abs. 2 BV, Art. 221 Abs. 1 StPO",), ("nichts",), (None,)], "t string")
    assert [r.c for r in texts.select(T.plain_citations("t").alias("c")).collect()] == [["Art. 221 Abs. 1 StPO", "Art. 5 Abs. 2 BV"], [], []]
    assert texts.select(T.numbered_law(F.lit("Art. 221 Abs. 1 lit. b StPO"))).first()[0] == "Art. 221 Abs. 1 312.0"
    gaps = spark.createDataFrame([("an english question",), ("ÄÖ 12 34 56 78",), ("",), (None,)], "q string")
    assert [r.g for r in gaps.select(T.language_gap("q").alias("g")).collect()] == [True, False, False, False]


CASCADE = [
    ("sparse_laws", 0, -1, 0, True, True, True, "unknown", False, False, False, "no_gold_in_candidates"),
    ("sparse_laws", 1, -1, 0, True, True, True, "laws_only", False, False, False, "query_language_gap"),
    ("sparse_laws", 1, -1, 0, False, True, True, "laws_only", False, False, False, "citation_pattern_missed"),
    ("sparse_laws", 1, 3, 1, True, True, True, "laws_only", False, False, False, "normalization_mismatch"),
    ("sparse_laws", 1, -1, 0, False, False, False, "court_only", False, False, False, "source_mismatch"),
    ("dense_court", 1, -1, 0, False, False, False, "laws_only", False, False, False, "source_mismatch"),
    ("fusion_final", 1, -1, 0, False, False, False, "mixed", True, False, False, "gold_lost_in_fusion"),
    ("dense_laws", 1, 250, 0, False, False, False, "laws_only", True, False, False, "no_gold_in_candidates"),
    ("dense_laws", 1, 60, 1, False, False, False, "laws_only", True, False, False, "gold_only_after_large_k"),
    ("fusion_final", 1, 3, 1, False, False, False, "mixed", True, True, False, "gold_lost_in_final_cut"),
    ("fusion_final", 1, 3, 1, False, False, False, "mixed", True, True, True, "ok"),
]


def test_all_labels_of_the_cascade(spark):
    names = "branch known first_hit at_200 gap pattern mismatch sources in_union in_fusion in_final want".split()
    df = spark.createDataFrame(CASCADE, names)
    label = E.failure_cascade(*[F.col(c) for c in names[:-1]])
    assert not df.where(label != F.col("want")).collect()
    assert len({c[-1] for c in CASCADE}) == 9


def test_all_reasons_of_a_missed_seed(spark):
    rows = [
        (True, 0, True, False, 0, False, False, False, False, "hit_in_fused_top200"), (False, 10, True, False, 1, False, False, False, False, "candidate_pool_too_shallow"),
        (False, 200, True, False, 1, True, True, True, True, "dense_not_triggered"), (False, 200, False, False, 0, True, True, True, True, "blocked_by_route_quota"),
        (False, 200, True, True, 1, False, False, True, True, "needs_anchor_rule"), (False, 200, True, True, 1, False, False, False, True, "not_retrieved_sparse"),
        (False, 200, True, True, 1, True, False, False, True, "not_retrieved_dense"), (False, 200, True, True, 1, False, True, False, True, "not_retrieved_sparse"),
        (False, 200, True, True, 1, True, True, False, True, "lost_in_merge"), (False, 200, True, True, 1, True, True, False, False, "eval_alignment_suspected"),
    ]
    names = "hit pool wanted ran quota sparse dense anchored fallback want".split()
    df = spark.createDataFrame(rows, names)
    assert not df.where(E.seed_miss_reason(*[F.col(c) for c in names[:-1]]) != F.col("want")).collect()


def test_three_way_falls_back_without_a_court_list(spark):
    lists = "query_id string, source string, citation string, rank int, laws_rank int"
    sparse = spark.createDataFrame([("a", "laws_de", "L", 2, 1), ("a", "court_considerations", "C", 1, 1), ("b", "laws_de", "L", 2, 1), ("b", "court_considerations", "C", 1, 1)], lists)
    court = spark.createDataFrame([("a", "C", 1)], "query_id string, citation string, rank int")
    got = {(r.query_id, r.citation): (r.score, r.mode[:8]) for r in FU.three_way(sparse, sparse.where("false"), court).collect()}
    assert got == {("a", "L"): (round(1 / 61, 6), "court_de"), ("a", "C"): (round(1 / 61, 6), "court_de"), ("b", "L"): (round(1 / 62, 6), "fallback"), ("b", "C"): (round(1 / 61, 6), "fallback")}


def test_cuts_by_sign_and_rerankers(spark):
    rows = spark.createDataFrame([("a", "x", 2.0, 1), ("a", "y", 1.7, 2), ("a", "z", 0.1, 3), ("a", "w", -1.0, 4), ("b", "v", -0.5, 1)], "query_id string, citation string, rerank_score double, rerank_rank int")
    kept = {m: "".join(sorted(r.citation for r in RR.cut_logits(rows, m).collect())) for m in ("positive", "top", "adaptive")}
    assert kept == {"positive": "xyz", "top": "vxyz", "adaptive": "vxy"}
    queries = spark.createDataFrame([("a",), ("c",)], "query_id string")
    assert {tuple(r) for r in RR.fill_empty(queries, rows.where("citation = 'x'"), "Art. 1 ZGB").collect()} == {("a", "x"), ("c", "Art. 1 ZGB")}
    with pytest.raises(ValueError):
        RR.cut_logits(rows, "other")
    candidates = spark.createDataFrame([("q", "Frage", "text", "laws_de", 0.5, 1, "x")], "query_id string, query string, body string, source string, fused_score double, fused_rank int, citation string")
    assert RR.no_rerank(candidates).first().rerank_score == 0.5
    strong = RR.scored_by(lambda q, b: F.length(q) + F.length(b))
    assert RR.rerank(candidates, RR.resolve_reranker(strong)[0], 5).first().rerank_score == 9
    assert RR.resolve_reranker(None)[0] is RR.token_overlap


def test_containment_and_okapi_against_brute_force(spark):
    rng = random.Random(2)
    texts = sorted({" ".join(rng.choices(["art.", "5", "or", "abs.", "2", "zgb"], k=rng.randint(1, 6))) for _ in range(200)})
    wanted = sorted({" ".join(rng.choices(["art.", "5", "or", "2"], k=rng.randint(1, 4))) for _ in range(40)})
    got = R.contained(spark.createDataFrame([(w,) for w in wanted], "pattern string"), spark.createDataFrame([(t,) for t in texts], "norm string"))
    assert {(r.pattern, r.norm) for r in got.collect()} == {(w, t) for w in wanted for t in texts if w in t}
    docs = [" ".join(rng.choices("abcdefgh", weights=[9, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(1, 9))) for _ in range(30)] + [None]
    queries = [(0, "a b"), (1, "C c d"), (2, "zz")]
    words = [(t or "").lower().split() for t in docs]
    df = Counter(w for ws in words for w in set(ws))
    raw = {t: math.log((len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    mean, avg = sum(raw.values()) / len(raw), sum(map(len, words)) / len(words)
    expected = set()
    for q, t in queries:
        scored = []
        for i, ws in enumerate(words):
            if set(ws) & set(t.lower().split()):
                s = sum((0.25 * mean if raw[w] < 0 else raw[w]) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in t.lower().split() if w in ws)
                scored.append((-round(s, 6), i))
        expected |= {(q, i, -s) for s, i in sorted(scored)[:4]}
    got = SP.okapi(spark.createDataFrame(list(enumerate(docs)), "id int, t string"), F.col("t"), "id", spark.createDataFrame(queries, "q int, t string"), "q", F.col("t"), 4)
    found = {(r.q, r.id): r.score for r in got.collect()}
    assert found.keys() == {(q, i) for q, i, _ in expected} and all(abs(found[q, i] - s) < 2e-6 for q, i, s in expected)


def test_one_encoder_for_corpus_and_queries(spark):
    rows = spark.createDataFrame([(1, "der Vertrag gilt"), (2, "die Miete steigt sehr"), (3, None), (4, "")], "id long, t string")
    vectors = {r.id: r.embedding for r in D.encode(rows, "t", D.hashed_encoder(32)).collect()}
    assert vectors[1] == D.hashed_vectors(rows, "id", F.col("t"), dims=32).where("id = 1").first().embedding
    assert sum(x * x for x in vectors[1]) == pytest.approx(1.0) and not any(vectors[3]) and not any(vectors[4])


def test_negatives(spark):
    gold = spark.createDataFrame([("q", "Art. 1 ZGB"), ("r", "X")], "query_id string, citation string")
    pool = spark.createDataFrame([("q", "Art. 1 ZGB", 1), ("q", "Art. 2 OR", 2), ("q", "Art. 3 ZGB", 3), ("q", "BGE", 4), ("r", "X", 1)], "query_id string, citation string, rank int")
    laws = spark.createDataFrame([("Art. 1 ZGB",), ("Art. 2 OR",), ("Art. 3 ZGB",)], "citation string")
    assert [r.negative for r in M.family_negatives(gold, pool, laws, True).collect()] == ["Art. 3 ZGB"]
    assert [r.negative for r in M.family_negatives(gold, pool, laws, False).collect()] == ["Art. 2 OR"]
    assert [tuple(r) for r in M.first_wrong(gold, pool).collect()] == [("q", "Art. 2 OR", 2)]


def test_pattern_mode_of_the_penalty(spark):
    rows = spark.createDataFrame([("laws_de", 0.1, 2.0, 0.1, 0.5, m, h) for m in ("df_only", "df_plus_dominance", "df_plus_dominance_plus_pattern") for h in (True, False)], "source string, c double, t double, x double, df_share double, mode string, pattern_hit boolean")
    rows = rows.withColumns({"df_threshold": F.lit(0.2), "dominance": F.lit(0.5), "low_citation": F.lit(0.3), "strength": F.lit(0.5)})
    assert [(r.mode, r.t) for r in G.title_penalty(rows).orderBy("mode", "t").collect()] == [("df_only", 1.0)] * 2 + [("df_plus_dominance", 1.0)] * 2 + [("df_plus_dominance_plus_pattern", 1.0), ("df_plus_dominance_plus_pattern", 2.0)]
    hits = spark.createDataFrame([("gesetz a",), ("x",), (None,)], "t string").select(G.pattern_hit(F.col("t"), ["x"], ["^gesetz"]).alias("h"))
    assert [r.h for r in hits.collect()] == [True, True, False]


def test_row_ids_summaries_triplets_and_runs(spark, tmp_path):
    rows = spark.createDataFrame([(s, i) for s in "ab" for i in range(57)], "source string, k int").repartition(5)
    assert sorted((r.source, r.k, r.row_id) for r in files.with_row_ids(rows, "k").collect()) == [(s, i, i) for s in "ab" for i in range(57)]
    files.write_summary(spark.createDataFrame([(1, 0.5)], "n int, f double"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().f == 0.5
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"query_id": str(i), "query": "q", "positive_text": "p", "negative_text": "n"}) for i in range(4)))
    assert files.read_triplets(spark, str(tmp_path / "t.jsonl")).count() == 4 and files.read_triplets(spark, str(tmp_path / "t.jsonl"), 2).count() == 2
    with pytest.raises(ValueError):
        P.run(spark, {"pipeline": "other"}, oracle.DATA)
    got = P.run(spark, {"pipeline": "bm25", "query_filter": "row_id % 20 = 0", "top_n": 2}, oracle.DATA)
    assert got.columns == ["query_id", "rank", "citation"] and got.where("rank > 2").count() == 0


def test_scratch_is_deleted_and_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    folder = runtime.scratch(spark, "test")
    spark.range(3).write.parquet(folder)
    runtime.clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(folder)

    class Elsewhere:
        class sparkContext:
            master = "spark://head:7077"

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        runtime.checkpoint_dir(Elsewhere)
