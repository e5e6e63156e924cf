from __future__ import annotations

import random

from tests.conftest import rows_of

from citeweave.operators import fusion as FU
from citeweave.plans import evaluation_queries as EQ
from citeweave.plans import retrieval_queries as RQ

HITS = "query_id string, list_id string, source string, citation string, score double"


def test_ranks_over_ranges_are_the_ranks_of_the_window(spark):
    rng = random.Random(3)
    rows = [("hot", "a", "laws_de", f"c{i}", float(rng.randrange(40))) for i in range(900)] + [(f"q{i % 30}", "b", "laws_de", f"c{i}", float(i % 7)) for i in range(200)]
    hits = spark.createDataFrame(rows, HITS)
    assert rows_of(FU.rank_whole(hits)) == rows_of(FU.rank_lists(hits))


def test_hits_beyond_rank_200_count(spark, monkeypatch):
    rows = [("q", "sparse_citation", "laws_de", f"X{i}", 2.0 - i / 1000) for i in range(250)] + [("q", "sparse_citation", "laws_de", "Art. 1 ZGB", 1.7)]
    rows += [("q", "sparse_title", "laws_de", "Art. 1 ZGB", 0.1)]
    gold = spark.createDataFrame([("q", "Art. 1 ZGB")], "query_id string, citation string")
    views = spark.createDataFrame([("q", "Art. 1 ZGB", ["Art. 1"], ["art"])], "query_id string, query string, numbers array<string>, words array<string>")
    monkeypatch.setattr(EQ.C, "hits", lambda s, d: spark.createDataFrame(rows, HITS))
    monkeypatch.setattr(EQ.C, "gold", lambda s, d: gold)
    monkeypatch.setattr(EQ, "query_views", lambda s, d: views)
    grid = {r.config_id: r.recall_at_100 for r in EQ.citation_boost_grid(spark, "").collect()}
    assert sorted(grid) == list(range(109)) and grid[0] == 0.0 and grid[108] == 1.0
    seen = {}
    monkeypatch.setattr(EQ.C, "doc_lookup", lambda c: spark.createDataFrame([], "norm string, source string, text string"))
    monkeypatch.setattr(EQ.C, "corpus", lambda s, d: None)
    monkeypatch.setattr(EQ.M, "hard_negatives", lambda views, gold, candidates, docs: candidates)
    fused = {r.citation: r["rank"] for r in EQ.hard_negatives(spark, "").collect()}
    assert fused["Art. 1 ZGB"] == 1  # 1/61 and, from rank 251, 1/311
    parts = EQ.G.components
    monkeypatch.setattr(EQ.G, "components", lambda fields: seen.setdefault("fields", fields) and parts(fields))
    EQ.fp_profile(spark, "")
    assert seen["fields"].count() == len(rows)
    assert RQ.lists(spark, "").count() == len(rows)
