from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeweave.llm.canon import Trie, map_to_reference

REFERENCE = [
    (1001, "Art. 5 Abs. 2 StGB", "Strafgesetzbuch", "863.407"),
    (1002, "Art. 12c Abs. 1bis HolzMV", "Holzmessverordnung", "884.442"),
    (1003, "Art. 7 ZGB", "Zivilgesetzbuch", "853.100"),
    (1004, "BGE 178 I 486 E. 6.9", None, None),
    (1005, "8C_634/2037 E. 8.6", None, None),
    (1006, "Art. 100 Abs. 2 IPRG", "Kollisionsrechtsgesetz", "840.280"),
    (1007, "Art. 8 DolmV", "Dolmetscherverordnung", "820.405"),
]
CASES = {
    "art 5 abs 2 stgb": 1001, "Artikel 5 Absatz 2 (Strafgesetzbuch)": 1001, "SR 863.407 Art. 5 Abs. 2": 1001, "Art. 5 Abs. 2 863.407": 1001, "StGB 5/2": 1001, "Art. 5 II StGB": 1001,
    "Art. 5 Abs. 2 lit. a Ziff. 3 StGB": 1001, "vgl. Art. 5 Abs. 2 StGGB": 1001, "§ 5 Abs. 2 Srtafgesezbuch": 1001, "art. 5 al. 2 StGB": 1001, "Atr. 5 Bas. 2 StGB": 1001,
    'Art. 5 Abs. 2 StGB ("Grundsatz")': 1001, "Art.12cAbs.1bis HolzMV": 1002, "HolzMV, Abs. 1bis Art. 12c": 1002, "Art. ７ ZGB": 1003, "BGE178I486 E.6.9": 1004, "ATF 178 I 486 c. 6.9": 1004,
    "178 I 486 E. 6.9": 1004, "BEG 178/I/486 E 6.9": 1004, "Urteil 8C_634/2037; E. 8.6": 1005, "8C.634/2037 E.8.6": 1005, "8C 634/2037 Erw. 8.6": 1005, "arrêt 8c-634/2037 consid. 8.6": 1005,
    "Art. 1OO Abs. 2 IPRG": 1006, "Art. 8 DolV": 1007, "Art. 8 Dlometscherverordnug": 1007,
    "Art. 2 Abs. 5 StGB": 0, "Art. 5 Abs. 2bis StGB": 0, "Art. 5 Abs. 2 ZGB": 0, "Art. 7 XGB": 0, "Art. 5 Abs. 2 BGB-Ost": 0, "BGE 178 I 486 E. 69": 0, "BGE 178 I 486": 0, "8C_634/2036 E. 8.6": 0,
    "unklar": 0, "": 0, "   ": 0, None: 0, "Art. 7 ZGB " + "x" * 5000: 1003,
}


def test_cases(spark):
    reference = spark.createDataFrame(REFERENCE, "canonical_id long, canonical_citation string, law_name string, sr_number string")
    df = spark.createDataFrame([(i, v, "clash", 9) for i, v in enumerate(CASES)], "i int, v string, canonical_citation string, canonical_id int")
    got = {r.i: r.canonical_id for r in map_to_reference(df, "v", reference).collect()}
    assert {v: got[i] for i, v in enumerate(CASES)} == CASES
    assert map_to_reference(df.where("false"), "v", reference).count() == 0
    many = map_to_reference(df.union(df), "v", reference)
    assert many.count() == 2 * len(CASES)


TWO_NAMES = [
    (1001, "Art. 1 Abs. 1 ZGB", "Zivilgesetzbuch", "853.100"), (1002, "Art. 2 ZGB", "Code civil", "853.100"), (1003, "Art. 1 Abs. 1 HG", "Handelsgesetz", "900.1"), (1004, "Art. 7 HG", "Heimatgesetz", "700.2"),
    (1005, "Art. 3 ARTG", "Artengesetz", "1.2"), (1006, "8C_634/2037 E. 8.6", None, None), (1007, "Art. 1 KUG", None, None), (1008, "Art. 9 VG", "Vereinsgesetz", None),
]
TWO_CASES = {
    "Art. 1 Abs. 1 Zivilgesetzbuch": 1001, "Art. 1 Abs. 1 Code civil": 0, "Art. 2 Zivilgesetzbuch": 1002, "SR 853.100 Art. 2": 1002, "Art. 7 Heimatgesetz": 1004, "Art. 7 Handelsgesetz": 0, "Art. 7 HG": 1004,
    "Art. 1 Abs. 1 Handelsgesetz": 1003, "Art. 3 Artg": 1005, "Art. 3 Artengesez": 1005, "8C 634/2037 E.8.6": 1006, "Art. 9 Vereinsgesetz": 1008,
}


@pytest.mark.parametrize("most", [200_000, 2])
def test_all_names_of_a_law_lead_to_its_entries_in_one_trie_or_in_shards(spark, monkeypatch, most):
    from citeweave.llm import canon

    monkeypatch.setattr(canon, "MOST_ENTRIES", most)
    for table, cases in ((TWO_NAMES, TWO_CASES), (REFERENCE, CASES)):
        reference = spark.createDataFrame(table, "canonical_id long, canonical_citation string, law_name string, sr_number string")
        df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string")
        got = {r.i: r.canonical_id for r in map_to_reference(df, "v", reference).collect()}
        assert {v: got[i] for i, v in enumerate(cases)} == cases


def test_a_list_of_many_laws(spark):
    reference = spark.range(2500).selectExpr("id + 1001 AS canonical_id", "concat('Art. ', id % 90 + 1, ' L', hex(id * 7919 + 65536), 'V') AS canonical_citation", "concat(hex(id * 104729 + 16777216), 'gesetz') AS law_name", "concat('9', id % 97, '.', id) AS sr_number")
    some = spark.createDataFrame([(r.canonical_citation.lower(), r.canonical_id) for r in reference.where("canonical_id % 331 = 0").collect()], "v string, want long")
    rows = map_to_reference(some, "v", reference).collect()
    assert len(rows) > 5 and all(r.canonical_id == r.want for r in rows)


def distance(a, b):
    d = {(-1, -1): 0}
    for i in range(-1, len(a)):
        for j in range(-1, len(b)):
            if (i, j) == (-1, -1):
                continue
            options = []
            if i >= 0:
                options.append(d[i - 1, j] + 1)
            if j >= 0:
                options.append(d[i, j - 1] + 1)
            if i >= 0 and j >= 0:
                options.append(d[i - 1, j - 1] + (a[i] != b[j]))
            if i > 0 and j > 0 and a[i] == b[j - 1] and a[i - 1] == b[j]:
                options.append(d[i - 2, j - 2] + 1)
            d[i, j] = min(options)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=8, unique=True), st.text("abc", max_size=6), st.integers(0, 2))
def test_trie_returns_all_names_within_distance(names, word, most):
    trie = Trie()
    for n in names:
        trie.add(n, n)
    assert trie.near(word, most) == sorted((distance(word, n), n) for n in names if distance(word, n) <= most)


@pytest.mark.parametrize(("word", "most"), [("or", 0), ("stgb", 1), ("strafgesetzbuch", 2)])
def test_distance_by_length(word, most):
    from citeweave.llm.canon import allowed_distance

    assert allowed_distance(word) == most
