from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from citeweave.llm.chunks import cut, split_oversized

PIECES = st.lists(st.sampled_from(["Satz eins hier. ", "wort ", "\n\n", "\n", "; ", "x" * 30, "　", "é", "👩‍⚖️ ", "Art. 5 "]), max_size=60)


def sound(text, limit, overlap):
    pieces = cut(text, limit, overlap)
    assert "".join(text[fresh:end] for _, fresh, end, _ in pieces) == text
    for k, (start, fresh, end, bound) in enumerate(pieces):
        assert 0 < end - start <= limit and 0 <= fresh - start <= overlap and start <= fresh < end
        if k:
            assert fresh == pieces[k - 1][2] and start >= pieces[k - 1][0]
    longest = max((len(w) for w in __import__("re").split(r"[\s　]+", text)), default=0)
    assert any(b == "hard" for *_, b in pieces) == (longest > limit and len(text) > limit)
    return pieces


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_any_text(parts):
    text = "".join(parts)
    if len(text) > 40:
        sound(text, 40, 10)


def test_borders_of_a_run():
    for n in (1050, 1051, 1199, 1200, 1201, 2600):
        sound("wort " * 300 + "y" * n + " ende" * 300, 1200, 150)
        sound("y" * n + " " + "z" * n, 1200, 150) if 2 * n > 1200 else None
    sound(" " * 3000, 1200, 150)


def test_ends_where_the_text_pauses():
    text = "Der Entscheid wird bestätigt. " * 60 + "\n\n" + "Ein anderer Abschnitt folgt hier. " * 60
    assert all(bound in ("sentence", "section", "end") for *_, bound in sound(text, 1200, 150))


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 400, "x"), (2, None, "x"), (3, "", "x"), (4, "k" * 1200, "x"), (5, "k" * 1201, "x"), (1, "a b " * 400, "x")], "id int, t string, piece string")
    got = split_oversized(df, ["id"], "t", 1200, 150).collect()
    assert {r.id for r in got} == {1, 5} and {r.id for r in got if r.row_hard} == {5}
    assert len([r for r in got if r.id == 1 and r.piece_no == 0]) == 2
    assert split_oversized(df.where("false"), ["id"], "t", 1200, 150).count() == 0
