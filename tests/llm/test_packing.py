from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeweave.llm.packing import BestFit, TokenCounter, pack_documents, sized_pieces
from citeweave.llm.queries import TOKENIZER_FILE

needs_vocabulary = pytest.mark.skipif(not os.path.exists(TOKENIZER_FILE), reason="no vocabulary file")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit(sizes):
    fit = BestFit(30)
    for i, s in enumerate(sizes):
        fit.add(s, i)
    assert sorted(i for b in fit.bins for i in b) == list(range(len(sizes)))
    rooms = [30 - sum(sizes[i] for i in b) for b in fit.bins]
    assert rooms == fit.room and all(r >= 0 for r in rooms)
    assert sum(r >= 15 for r in rooms) <= 1


@needs_vocabulary
def test_counts_are_exact():
    counter = TokenCounter(TOKENIZER_FILE)
    for text in ("", " ", "a b", "a  b", "a   b ", "  lead", "x\n y", "x \n y", "it's 1 234.5!", "tab\t tab", "né  \xa0 x", "A.________ 🖋️ x", "end  ", "a\n\n b"):
        assert counter.count(text) == len(counter.encode(text)), repr(text)


@needs_vocabulary
def test_oversized_texts_are_cut_whole():
    counter = TokenCounter(TOKENIZER_FILE)
    for text in ("wort " * 500, "x" * 3000, "é" * 900 + " " + "kurz " * 40, "a b"):
        pieces = sized_pieces(counter, text, 100)
        assert "".join(text[a:b] for a, b, _ in pieces) == text
        assert all(n == len(counter.encode(text[a:b])) <= 100 for a, b, n in pieces)


@needs_vocabulary
def test_containers(spark):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["Recht", "Frist", "und", "x"], k=rng.choice([1, 5, 20, 60, 90, 300]))), "clash") for i in range(400)] + [(900, None, "c"), (901, "", "c"), (902, "  ", "c"), (None, "ohne", "c"), (3, "doppelt", "c")]
    df = spark.createDataFrame(rows, "id long, t string, container_id string").repartition(7)
    got = pack_documents(df, "id", "t", 128, TOKENIZER_FILE, fan_in=2, keep=3).collect()
    used: dict = {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 128
    counter = TokenCounter(TOKENIZER_FILE)
    whole = [r for r in rows if r[1]]
    assert sum(used.values()) == sum(counter.count(t) for _, t, _ in whole)
    assert sorted(str(r.doc_id) for r in got if r.piece_no == 0) == sorted(str(i) for i, _, _ in whole)
    assert len(used) <= 1.1 * sum(used.values()) / 128 + 2
    assert pack_documents(df.where("false"), "id", "t", 128, TOKENIZER_FILE).count() == 0


@needs_vocabulary
def test_underfull_containers_of_one_task_are_filled_from_another(spark):
    """One partition of texts over half a container and one of texts that fill them: all of them meet."""
    counter = TokenCounter(TOKENIZER_FILE)
    texts = {n: "x" + " x" * (n - 1) for n in (70, 56)}
    assert all(counter.count(t) == n for n, t in texts.items())
    rows = [(i, texts[70 if i < 600 else 56]) for i in range(1200)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "id long, t string")
    for most in (100_000, 150):
        got = pack_documents(df, "id", "t", 128, TOKENIZER_FILE, most=most).collect()
        assert sorted(r.doc_id for r in got) == list(range(1200))
        used: dict = {}
        for r in got:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        assert max(used.values()) <= 128 and len(used) <= 600 + (0 if most > 1200 else 60)
