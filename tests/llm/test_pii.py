from __future__ import annotations

import random

from citeweave.llm.pii import find_personal, mask, redact, redact_personal

TEXT = (
    "Herr Dr. Reto K. Brügghölzer widersprach. Frau  Ramsauer blieb dabei. Mit ZORA D'MORETTI wurde ein Vergleich geschlossen. gez. Tanninger, Giulia\n"
    "Die Tanninger AG hat ihren Sitz in Tannau. A.________ und B.________ AG erschienen nicht. Pascal B. Ruchdorfer had paid in cash. Me N. de Planfeldt plaide.\n"
    "Kontakt: jelena.75 (at) post-tannau (punkt) test oder <X_Y@MAIL.EXAMPLE>. Am Schalter @ Kanzlei war niemand.\n"
    "Tel. +41 (0)20 784 97 44, Natel 059/669.13.91, Call (059) 449 83 12 or 0207946039 or 030 23125 687 or 01 99 00 30 67.\n"
    "AHV-Nr. 756.8915.7698.61, No. QQ 44 49 79 C, Passeport X8R70005, 2 74 10 85 588 918 37. Vgl. Ordnungsnummer 2033-0262-59. SR 821.864.27.12. Pièce 923.25.58 du dossier.\n"
    "Adresse Unterer Klostergraben Nr. 27\n9998 Tannau. Wohnsitz: Weiherstr. 78. Domicile : 169, chemin du Vieux-Moulin\nNotifié à quai des Bateliers 133b, 9997 Nordau. Served at 160 c St. Odo's Square, Tannau. "
    "Domicilio: salita alla Segheria 57\nDas Bezirksgericht Nordau tagte an der Birkengasse. Grundbuchblatt 301, Parzelle 5048, Plan 50. Nach BGE 178 I 486 E. 6.9 und Art. 5 Abs. 2 StGB am 02.08.2035 Fr. 33'181.50."
)
EXPECTED = {
    "person": {"Reto K. Brügghölzer", "Ramsauer", "ZORA D'MORETTI", "Tanninger, Giulia", "Pascal B. Ruchdorfer", "N. de Planfeldt"},
    "email": {"jelena.75 (at) post-tannau (punkt) test", "X_Y@MAIL.EXAMPLE"},
    "phone": {"+41 (0)20 784 97 44", "059/669.13.91", "(059) 449 83 12", "0207946039", "030 23125 687", "01 99 00 30 67"},
    "identity": {"756.8915.7698.61", "QQ 44 49 79 C", "X8R70005", "2 74 10 85 588 918 37"},
    "address": {"Unterer Klostergraben Nr. 27", "Weiherstr. 78", "169, chemin du Vieux-Moulin", "quai des Bateliers 133b", "160 c St. Odo's Square", "salita alla Segheria 57"},
}


LEARNED = {"ZORA D'MORETTI", "Pascal B. Ruchdorfer"}


def people(seed, n, family):
    rng = random.Random(seed)
    return [f"{rng.choice('Anna Beat Carla Dario Elena Fabio Gina Hugo Ines Jonas'.split())} {rng.choice(family)}{rng.choice(('inger', 'wald', 'etti', 'oser', 'ander', 'ikon'))}" for _ in range(n)]


def corpus(held_out):
    """Announced names of known families in the wordings of the held-out ones, and texts without names."""
    known = people(1, 400, ["Kor", "Brem", "Zum", "Hal", "Tann", "Vel"])
    rows = [f"Herr {n} widersprach. Mit {m} wurde ein Vergleich geschlossen. Die Klägerin {o} unterlag vor Gericht." for n, m, o in zip(known, known[7:], known[13:])]
    rows += [f"Frau {n} schwieg. Gestern half {m} sofort mit. {o} had paid in cash." for n, m, o in zip(known, known[11:], known[17:])]
    rows += [f"Das Bezirksgericht Nordau tagte. Die Kanton Bern Behörde half Leuten sofort. Gemäss Schweizer Recht {i} unterlag niemand. The Swiss Federal Court had paid attention. A Federal Court ruled. No Federal Court sat." for i in range(300)]
    return rows + held_out


def test_names_that_no_cue_announces(spark):
    names = people(2, 120, ["Quell", "Osch", "Ypsel", "Uhl"])
    frames = ["Die Klägerin {} unterlag vor Gericht.", "Gestern half {} sofort mit.", "Mit {} wurde ein Vergleich geschlossen.", "{} had paid in cash."]
    held_out = [frames[i % 4].format(n) for i, n in enumerate(names)]
    docs = spark.createDataFrame(list(enumerate(corpus(held_out))), "id long, t string")
    first = len(corpus([]))
    found = find_personal(docs, "id", "t").where("pii_type = 'person'").collect()
    got = {(r.doc_id, r.found_text) for r in found if r.doc_id >= first}
    expected = {(first + i, n) for i, n in enumerate(names)}
    assert len(got & expected) >= 0.9 * len(expected) and len(got & expected) >= 0.9 * len(got)
    assert not [r for r in found if "Bezirksgericht" in r.found_text or "Court" in r.found_text or "Bern" in r.found_text]
    masked = {r.doc_id: r.text for r in redact_personal(docs, "id", "t").where(f"doc_id >= {first}").collect()}
    assert sum(masked[first + i] == frames[i % 4].format("[PERSON]") for i in range(len(names))) >= 0.9 * len(names)


def test_wordings_of_a_corpus_complete_the_names_of_a_text(spark):
    docs = spark.createDataFrame([(10_000, TEXT), *enumerate(corpus([]))], "id long, t string")
    found = {r.found_text for r in find_personal(docs, "id", "t").where("doc_id = 10000 AND pii_type = 'person'").collect()}
    assert found == EXPECTED["person"]


def test_masking_where_the_text_is_read(spark):
    docs = spark.createDataFrame([(1, "Herr Beat Zumoser, Tel. 01 99 00 30 67, kam."), (1, "Nichts von Beat Zumoser"), (2, None), (3, ""), (None, "Frau Zumoser"), (4, "<X_Y@MAIL.EXAMPLE>"), (5, "Herr Beat Zumoser kam.")], "id long, t string")
    got = redact_personal(docs, "id", "t")
    assert sorted((r.doc_id or 0, r.text) for r in got.where("text IS NOT NULL").collect()) == [(0, "Frau [PERSON]"), (1, "Herr [PERSON], Tel. [PHONE], kam."), (1, "Nichts von [PERSON]"), (3, ""), (4, "<[EMAIL]>"), (5, "Herr [PERSON] kam.")]
    assert got.count() == 7
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert redact_personal(docs.where("false"), "id", "t").count() == 0


def test_a_threshold_of_bits_keeps_passages_that_many_documents_hold(spark):
    docs = spark.createDataFrame([(i, f"Zentrale 01 99 00 30 67, direkt 059/669.13.{i + 10}.") for i in range(40)], "id long, t string")
    found = find_personal(docs, "id", "t", bits={"phone": 1.0}).collect()
    assert sorted(r.found_text for r in found) == [f"059/669.13.{i + 10}" for i in range(40)]


def test_notations_and_cues(spark):
    rows = [(1, TEXT, "c"), (1, TEXT, "again"), (2, None, "c"), (3, "", "c"), (None, TEXT, "c"), (4, "Nichts. " * 20000, "c")]
    docs = spark.createDataFrame(rows, "id long, t string, pii_type string")
    found = find_personal(docs, "id", "t")
    got: dict = {}
    for r in found.collect():
        assert r.doc_id == 1
        assert r.found_text not in got.setdefault(r.pii_type, set())
        got[r.pii_type].add(r.found_text)
    # One document teaches no wordings: only what a notation, an address, a title or a signature gives away.
    assert got == EXPECTED | {"person": EXPECTED["person"] - LEARNED}
    assert find_personal(docs.where("false"), "id", "t").count() == 0


def test_co_occurrence_tells_names_from_common_words(spark):
    names = [(i, "Herr Beat Zumoser widersprach. Frau Zumoser blieb dabei.") for i in range(20)]
    common = [(100 + i, "Der Zeuge Entscheid fehlt. Ein Entscheid der Behörde. Der Entscheid gilt. Dieser Entscheid auch. Zum Entscheid. Am Entscheid. Beim Entscheid. Vom Entscheid. Ohne Entscheid. Nach Entscheid.") for i in range(20)]
    bare = [(200, "Gestern kam Beat Zumoser vorbei."), (201, "Die Zumoser Holding AG zahlt.")]
    found = {(r.doc_id, r.found_text) for r in find_personal(spark.createDataFrame(names + common + bare, "id long, t string"), "id", "t").where("pii_type = 'person'").collect()}
    assert {(i, "Beat Zumoser") for i in range(20)} <= found and (200, "Beat Zumoser") in found
    assert not any(d == 201 or t == "Entscheid" for d, t in found)


def test_masking_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "Frau Meier, Meierhof, Tel. 01 99 00 30 67."), (2, "nichts"), (3, None)], "id long, t string")
    found = spark.createDataFrame([(1, "person", "Meier"), (1, "phone", "01 99 00 30 67")], "doc_id long, pii_type string, found_text string")
    got = {r.doc_id: r.text for r in redact(docs, "id", "t", found).collect()}
    assert got == {1: "Frau [PERSON], Meierhof, Tel. [PHONE].", 2: "nichts", 3: None}
    assert mask("a", None) == "a"
