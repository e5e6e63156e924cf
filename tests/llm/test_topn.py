from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeweave.llm.queries import QUERIES, SQL
from citeweave.llm.topn import LoserTree, top_n_per_group
from tests import oracle


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    tree, out = LoserTree([sorted(r) for r in runs]), []
    while (x := tree.pop()) is not None:
        out.append(x)
    assert out == sorted(x for r in runs for x in r)


def brute(rows, n):
    best = {}
    for g, c, s, v in rows:
        if c is not None and v is not None and v == v:
            best[g, c, s] = max(v, best.get((g, c, s), v))
    out = []
    for group in {g for g, _, _ in best}:
        mine = sorted((-v, c, s is None, s or "") for (g, c, s), v in best.items() if g == group)
        out += [(group, i + 1, c, None if none else s, -v) for i, (v, c, none, s) in enumerate(mine[:n])]
    return out


@pytest.mark.parametrize("fan_in", [2, 256])
def test_against_brute_force(spark, fan_in):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["x", "y", "z", "é", "Z", None, *map(str, range(40))]), rng.choice(["s", "t", None]), rng.choice([1.0, 2.0, 2.0, -1.0, float("nan"), None, rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "g string, c string, s string, v double, _g string, item_rank int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = [tuple(r) for r in top_n_per_group(df.select("g", "c", "s", "v", "_g"), "g", "v", ["c", "s"], 7, fan_in=fan_in).select("g", "item_rank", "c", "s", "v").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, 7), key=key)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, c string, v double")
    assert top_n_per_group(df, "g", "v", ["c"], 3).count() == 0
    some = spark.createDataFrame([("a", "x", 1.0)], "g string, c string, v double")
    assert top_n_per_group(some, "g", "v", ["c"], 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    oracle.assert_same(spark, QUERIES[name], SQL[name])


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, oracle.DATA).collect()
    assert rows and (not name.endswith("_found") or len(rows) == len(set(rows)))
