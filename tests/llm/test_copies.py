from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from citeweave.llm.copies import canonical_citation, canonical_text, court_key, group_copies

SAME = [
    ("Art. 72 Abs. 2 BrückLV", "BrückLV, Abs.2 Art.72"),
    ("Art. 25 SchKG", "SchKG Art.25"),
    ("Art. 100a Abs. 3 DrohnG", "(DrohnG Art. 100a Abs. 3)"),
    ("Art. 67b Abs. 1 GwNutzV", "Art.67bAbs.1\xa0GwNutzV"),
    ("Art. 87 Abs. 1bis MusLizG", "Art.87, Abs.1bis MusLizG"),
    ("5D_1197/2033 E. 3.1", "5d_1197/2033 e. 3.1"),
    ("9C_819/2033, E. 8", "E. 8 – 9C_819/2033"),
    ("4A_1247/2039 E. 3.8", "E.3.8 4A 1247/2039"),
    ("BGE 178 V 792 E. 5.7", "E 5.7, BGE \t178 \tV 792"),
    ("Art. 1 STRASSE", "art. 1 straße"),
]
APART = [
    ("BGE 178 III 582 E. 2.7", "BGE 178 III 582 E. 27"),
    ("Art. 3 Abs. 5 ZGB", "Art. 5 Abs. 3 ZGB"),
    ("BGE 169 I 422 E. 5", "BGE 422 I 169 E. 5"),
    ("Art. 58c Abs. 3 PostZuV", "Art. 58c Abs. 3bis PostZuV"),
    ("Art. 42 Abs. 1 ArchZG", "Art. 42d Abs. 1 ArchZG"),
    ("5D_10/2032 E. 7", "5D_102/032 E. 7"),
]


@pytest.mark.parametrize(("a", "b", "same"), [(*p, True) for p in SAME] + [(*p, False) for p in APART])
def test_citations(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(canonical_citation(F.col("a")).alias("a"), canonical_citation(F.col("b")).alias("b")).first()
    assert (row.a == row.b) is same


def test_text(spark):
    pairs = [("Er zahlt Fr. 6.20, sofort.", "ER  ZAHLT FR 6.20 sofort", True), ("Fr. 6.20", "Fr. 620", False), ("a b", "ab", True), ("12 3", "1 23", False), (None, " ", True), ("é", "e", False)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert all((r.x == r.y) is r.same for r in df.select("same", canonical_text(F.col("a")).alias("x"), canonical_text(F.col("b")).alias("y")).collect())


def test_groups_against_brute_force_with_a_hot_key(spark):
    rows = [(i, "BGE 1 I 2 E. 3" if i % 3 else "e. 3 bge 1 i 2", "Hot  text." if i % 2 else "hot TEXT", "x") for i in range(3000)]
    rows += [(10_000 + i, f"BGE {i % 40} I 2 E. 3", f"Text {i % 25}!", "x") for i in range(500)] + [(20_000, None, None, "x"), (20_001, "", " ", "x"), (5, "BGE 1 I 2 E. 3", "hot text", "x")]
    df = spark.createDataFrame(rows, "row_id long, citation string, text string, copies string")
    got = group_copies(df, court_key(), "row_id").collect()
    key = lambda c, t: ("|".join(sorted(re.findall(r"[a-z]+\W*\d+(?:\W*i\W*\d+)?", (c or "").lower().replace(".", ""))) if c and c.strip() else []), re.sub(r"[\W_]+", "", (t or "").lower()))
    groups: dict = {}
    for i, c, t, _ in rows:
        groups.setdefault(key(c, t), []).append(i)
    expected = sorted((min(g), len(g), i) for g in groups.values() for i in g)
    assert sorted((r.first_row_id, r.copies, r.row_id) for r in got) == expected


def test_empty(spark):
    assert group_copies(spark.createDataFrame([], "row_id long, citation string, text string"), court_key(), "row_id").count() == 0


def test_a_border_mark_in_the_text_is_white_space(spark):
    from pyspark.sql import functions as F

    from citeweave.llm.copies import canonical_text

    df = spark.createDataFrame([("E. 6 2",), ("E. 6\u00012",), ("E. 62",), ("\u0001E.\u000162",)], "t string")
    a, b, c, d = (r[0] for r in df.select(canonical_text(F.col("t"))).collect())
    assert a == b and c == d and a != c
