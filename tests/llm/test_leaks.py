from __future__ import annotations

import random

from citeweave.llm.leaks import align, leaked_items

SLOTS = [f"{a}{b}{c}" for a in "kor mel tun bras vel hag pim zot rul dor".split() for b in "fin gor lat mun vash pel kir tom".split() for c in "dek sol ran tib hum jek wip lor".split()]


def texts(seed, n=40):
    rng = random.Random(seed)
    return " ".join(w for _ in range(n // 4) for w in ("der", rng.choice(SLOTS), "gegen", rng.choice(SLOTS)))


def test_alignment_scores_and_span():
    item = list(range(1, 21))
    cases = [(item, item), (item, [0, 0, *item[3:18], 0]), (item, [*item[:5], 0, *item[6:12], 99, *item[12:]]), (item, [0, 0]), (item, list(reversed(item)))]
    got = align(cases)
    assert got[0] == (20, 0, 19) and got[1] == (15, 3, 17) and got[2] == (20 - 1 - 1 - 1, 0, 19) and got[3][0] == 0 and got[4][0] == 1


def test_cases(spark):
    items = {i: texts(i) for i in range(1, 13)}
    w = items[1].split()
    edited = " ".join(("neu" if k % 6 == 5 else x) for k, x in enumerate(items[2].split()))
    spelt = " ".join((x[:2] + x[3:] if k % 4 == 3 and len(x) > 5 else x) for k, x in enumerate(items[3].split()))
    broken = " ".join((x[:3] + " " + x[3:] if k % 5 == 3 and len(x) > 5 else x) for k, x in enumerate(items[4].split()))
    shuffled = items[5].split()
    random.Random(1).shuffle(shuffled)
    docs = {
        1: "Vorspann. " + items[1].upper().replace(" ", ",\n") + " Nachspann.", 2: "x y " + edited, 3: spelt + " z", 4: broken, 5: " ".join(shuffled), 6: "so die Frage " + " ".join(w[8:16]) + " weiter",
        7: "davor " + " ".join(w[10:28]) + " danach", 8: texts(99), 9: None, 10: "", 11: items[6] + " lang " * 9000 + items[7], 12: "der gegen " * 50,
    }
    corpus = spark.createDataFrame([(i, t, "clash") for i, t in docs.items()] + [(1, docs[1], "again"), (None, docs[1], "x")], "id long, t string, item_id string")
    wanted = spark.createDataFrame([(i, t) for i, t in items.items()] + [(77, None), (78, "kurz"), (None, "x")], "iid long, body string")
    expected = {(1, 1), (2, 2), (3, 3), (4, 4), (7, 1), (11, 6), (11, 7)}
    for block in (5000, 4):
        assert {tuple(r) for r in leaked_items(corpus, "id", "t", wanted, "iid", "body", block=block).collect()} == expected
    assert leaked_items(corpus.where("false"), "id", "t", wanted, "iid", "body").count() == 0
    assert leaked_items(corpus, "id", "t", wanted.where("false"), "iid", "body").count() == 0


def test_an_item_that_leaked_everywhere_is_still_found(spark):
    items = spark.createDataFrame([(i, texts(i)) for i in range(1, 6)], "iid long, body string")
    docs = spark.createDataFrame([(i, texts(1) if i % 3 == 0 else texts(1000 + i)) for i in range(90)], "id long, t string")
    got = {tuple(r) for r in leaked_items(docs, "id", "t", items, "iid", "body").collect()}
    assert got == {(i, 1) for i in range(0, 90, 3)}


def found(spark, docs, items, **options):
    corpus = spark.createDataFrame(list(docs.items()), "id long, t string")
    wanted = spark.createDataFrame(list(items.items()), "iid long, body string")
    return {tuple(r) for r in leaked_items(corpus, "id", "t", wanted, "iid", "body", **options).collect()}


def test_a_common_passage_of_an_item_is_found_beside_its_rare_seeds(spark):
    items = {i: texts(i, 80) for i in range(1, 6)}
    hot = " ".join(items[1].split()[20:40])
    docs = {i: f"{texts(500 + i)} {hot} {texts(900 + i)}" if i % 3 == 0 else texts(1000 + i) for i in range(90)}
    docs[100] = items[1]
    assert found(spark, docs, items) == {(i, 1) for i in range(0, 90, 3)} | {(100, 1)}


def test_one_replaced_inner_word_never_loses_a_passage(spark):
    items = {i: texts(i, 80) for i in range(1, 8)}
    docs, expected = {}, set()
    for at in (0, 1, 2, 3):
        for k in range(1, 14):
            words = items[1].split()[at : at + 15]
            words[k] = "ersetzt"
            n = len(docs)
            docs[n] = f"{texts(600 + n)} {' '.join(words)} {items[2] if n % 2 else texts(700 + n)}"
            expected |= {(n, 1), (n, 2)} if n % 2 else {(n, 1)}
    assert found(spark, docs, items) == expected


def test_wording_of_many_items_is_found_in_each_and_two_edits_in_a_row_end_a_passage(spark):
    shared = " ".join(texts(50, 24).split()[:20])
    items = {i: f"{shared} {texts(i)}" for i in range(1, 8)}
    docs = {1: f"vorn {shared} hinten", 2: items[3]}
    every = {(1, i) for i in items} | {(2, i) for i in items}
    assert found(spark, docs, items) - every == set()
    assert found(spark, docs, items) >= {(1, i) for i in items} | {(2, 3)}
    assert found(spark, docs, items, block=2) == found(spark, docs, items)
    words = items[1].split()[20:48]
    words[12:14] = ["ganz", "anders"]
    assert found(spark, {1: " ".join(words[:26])}, items) == set()


def test_an_item_that_only_shares_phrasing_gives_way(spark):
    words = texts(60, 40).split()
    near = [("anders" if k % 6 == 5 else w) for k, w in enumerate(words)]
    items = {1: " ".join(words), 2: " ".join(near), 3: texts(3)}
    assert found(spark, {1: items[1], 2: items[2]}, items) == {(1, 1), (2, 2)}


def test_a_word_put_in_that_reads_like_two_of_the_item(spark):
    words = texts(70, 40).split()
    items = {1: " ".join(["zu", "dem", *words])}
    assert found(spark, {1: " ".join([*words[:8], "zudem", *words[8:15]])}, items) == {(1, 1)}


def test_items_of_one_wording_are_all_found(spark):
    for many in (4, 40):
        items = {i: texts(1) for i in range(many)} | {100: texts(2), 101: texts(1).upper()}
        for block in (50_000, 20):
            assert found(spark, {1: f"vorn {texts(1)} hinten", 2: texts(3)}, items, block=block) == {(1, i) for i in range(many)} | {(1, 101)}


def test_many_items_are_met_in_one_pass_over_the_documents(spark):
    items = spark.createDataFrame([(i, texts(i)) for i in range(2000)], "iid long, body string")
    docs = spark.createDataFrame([(i, f"{texts(90_000 + i)} {texts(i * 7 % 2500)}") for i in range(300)], "id long, t string")
    got = leaked_items(docs, "id", "t", items, "iid", "body")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows, expected = {tuple(r) for r in got.collect()}, {(i, i * 7 % 2500) for i in range(300) if i * 7 % 2500 < 2000}
    # Of the few made-up words here, 600,000 pairs hold a stretch by chance now and then.
    assert rows >= expected and len(rows - expected) <= 3


def test_edits_that_were_used_to_choose_nothing(spark):
    """Recall and precision on edits drawn at random: words put in, left out, replaced, misspelt, broken and run together."""
    rng = random.Random(5)
    items = {i: texts(3000 + i, 80) for i in range(60)}
    docs, expected = {}, set()
    for n in range(600):
        i = rng.randrange(60)
        words = items[i].split()
        size = rng.randint(20, 60)
        at = rng.randrange(len(words) - size)
        part, k = words[at : at + size], rng.randint(2, 6)
        while k < len(part) - 3:
            how = rng.randrange(5)
            if how == 0:
                part[k] = "fremd"
            elif how == 1:
                part.insert(k, "dazu")
            elif how == 2:
                del part[k]
            elif how == 3 and len(part[k]) > 5:
                part[k] = part[k][:2] + part[k][3:]
            elif how == 4:
                part[k : k + 2] = [part[k] + part[k + 1]]
            k += rng.randint(6, 9)
        docs[n] = f"{texts(7000 + n)} {' '.join(part)} {texts(8000 + n)}"
        expected.add((n, i))
    got = found(spark, docs, items)
    assert len(got & expected) >= 0.99 * len(expected) and len(got & expected) >= 0.99 * len(got)
