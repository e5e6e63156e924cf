from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from citeweave.operators.packed_values import resolve, split_packed

CASES = {
    "Art. 1 BV; Art. 2 BV": ["Art. 1 BV", "Art. 2 BV"],
    "«BGE 1 I 2 E. 3» | \"art 11\" ; ": ["BGE 1 I 2 E. 3", "art 11"],
    '["Art. 1 (\\"Grundsatz\\")" , "5A_1/2030, E. 2"]': ['Art. 1 ("Grundsatz")', "5A_1/2030, E. 2"],
    '"Art. 2 (""Grundsatz"")";Art. 3': ['Art. 2 ("Grundsatz")', "Art. 3"],
    "9C_1/2030 E. 1 / Art. 5 • Art. 6\tArt. 7\nArt. 8；Art. 9": ["9C_1/2030 E. 1", "Art. 5", "Art. 6", "Art. 7", "Art. 8", "Art. 9"],
    "﻿Art. 1;Art. 1;": ["Art. 1", "Art. 1"],
    "'Urteil 8C_1/2030; E. 3';x": ["Urteil 8C_1/2030; E. 3", "x"],
    "a'b;c": ["a'b", "c"],
    "'never closed; b": ["'never closed", "b"],
    "BGE 183/IV/74": ["BGE 183/IV/74"],
    " ; , | ": [],
    "plain": ["plain"],
    "  spaced  ": ["spaced"],
}


def split(spark, fields):
    df = spark.createDataFrame([(i, f, "x") for i, f in enumerate(fields)], "id int, f string, value string")
    out: dict[int, list[str]] = {}
    for r in split_packed(df, "f", ["id"]).orderBy("id", "pos").collect():
        assert r.pos == len(out.setdefault(r.id, []))
        out[r.id].append(r.value)
    return [out.get(i, []) for i in range(len(fields))]


def test_cases(spark):
    assert split(spark, list(CASES)) == list(CASES.values())


def test_nulls_blanks_repeats_and_long_fields(spark):
    long = ";".join(f"Art. {i} BV" for i in range(3000))
    assert split(spark, [None, "", "  ", "a;b", "a;b", long]) == [[], [], [], ["a", "b"], ["a", "b"], long.split(";")]
    assert split_packed(spark.createDataFrame([], "id int, f string"), "f", ["id"]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="xs;,/\"'«»[]\\\n", max_size=14))
def test_rules_use_each_token_once_and_in_order(skel):
    places = [i for value in resolve(skel) for i in value]
    assert places == sorted(set(places))
    assert all(value for value in resolve(skel))


def test_tokens_are_cut_once_a_field(spark):
    df = spark.createDataFrame([(1, "a; b")], "id int, f string")
    plan = split_packed(df, "f", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    # One branch for the rows of hot skeletons, one for the others; in each, outside the inner lambda and not in a filter.
    assert plan.count("regexp_extract_all") == plan.count("AS _v#") - 1 == plan.count("transform(array(regexp_extract_all") == 2


def test_long_fields_with_many_words_and_unclosed_quotes(spark):
    words, opened = "wort " * 100_000 + "; x", "„a;" * 5000
    assert split(spark, [words, opened]) == [["wort " * 99_999 + "wort", "x"], ["„a"] * 5000]
