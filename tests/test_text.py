from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.functions import understanding as U


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("typed", "expected"),
    [
        ("Art. 221 Abs. 1 lit. b StPO", "Art. 221 Abs. 1 StPO"),
        ("Art .  5 Abs . 2  ZGB;", "Art. 5 Abs. 2 ZGB"),
        ("Art. 5 Ziff. 3 OR", "Art. 5 OR"),
        ("Art. 9 lit. c Ziff. 2 VRV", "Art. 9 VRV"),
        ("Art.\xa08 BV。", "Art. 8 BV"),
        ("BGE 137 IV 122 E . 6.2", "BGE 137 IV 122 E. 6.2"),
        ("Art. 1 Abs. 2 lit. bbis AIG", "Art. 1 Abs. 2 lit. bbis AIG"),
        ("Art. ５６７ StPO", "Art. 567 StPO"),
        (None, ""),
        ("", ""),
    ],
)
def test_normalize_citation(spark, typed, expected):
    assert one(spark, typed, T.normalize_citation) == expected


def test_exact_normalisation_agrees_beyond_folded_forms(spark):
    assert one(spark, "ﬁne ① ｘ", T.normalize_text_exact) == "fine 1 x"


def test_split_keeps_order_and_repetitions(spark):
    assert one(spark, "Art. 1 BV; ;Art. 2 BV;Art. 1 BV", T.split_citations) == ["Art. 1 BV", "Art. 2 BV", "Art. 1 BV"]


@pytest.mark.parametrize(
    ("norm", "key"),
    [
        ("Art. 221 Abs. 1 StPO", "STATUTE::STPO::ART::221"),
        ("Art. 2 830.22", "STATUTE::UNK::ART::2"),
        ("Art. 28 Abs. 1bis ZGB", "STATUTE::ZGB::ART::28"),
        ("Art. 41a OR", "STATUTE::OR::ART::41A"),
        ("BGE 137 IV 122 E. 6.2", "EXACT::BGE 137 IV 122 E. 6.2"),
        ("", ""),
    ],
)
def test_paragraph_key(spark, norm, key):
    assert one(spark, norm, T.paragraph_key) == key


SAMPLE = "May a court order extension under Art. 221 Abs. 1 lit. b StPO and BGE 137 IV 122 E. 6.2? Paragraph 3 applies, see section 14 and case 1B_210/2023 E. 4.1."


def test_number_patterns(spark):
    assert one(spark, SAMPLE, T.number_patterns) == ["Art. 221 Abs. 1 lit. b StPO", "section 14", "Paragraph 3", "1B_210/2023", "1B_210/2023 E. 4.1", "BGE 137 IV 122 E. 6.2", "221 Abs", "137 IV"]


def test_title_template(spark):
    assert one(spark, "Verordnung vom 5. Juni 1990 über Gebühren (GebV) - Kapitel 2", T.title_template) == "verordnung vom <num> juni <num> ueber gebuehren"


@pytest.mark.parametrize(
    ("query", "counted", "scored"),
    [
        ("8C_160/2016 E. 4.1 with burden of proof", ("court", "high"), ("court", "high")),
        ("Art. 221 Abs. 1 lit. b StPO proportionality", ("laws", "high"), ("laws", "high")),
        ("BGE 137 IV 122 E. 6.2 and Art. 29 BV", ("hybrid", "high"), ("hybrid", "high")),
        ("general legal issue without citation", ("hybrid", "low"), ("hybrid", "low")),
        ("is it theft or fraud", ("laws", "medium"), ("hybrid", "low")),
        ("theft or fraud or both", ("laws", "high"), ("laws", "medium")),
    ],
)
def test_routes(spark, query, counted, scored):
    row = spark.createDataFrame([(query,)], "x string").select(U.route(F.col("x")).alias("a"), U.route_scored(F.col("x")).alias("b")).first()
    assert (row.a.route, row.a.confidence) == counted
    assert (row.b.route, row.b.confidence) == scored


def test_families_issues_and_quota(spark):
    q = "Is pretrial detention lawful where collusion is feared?"
    assert one(spark, q, U.likely_families) == ["STPO"]
    groups = one(spark, q, lambda c: U.issue_groups(c, U.likely_families(c)))
    assert groups == ["STPO:pretrial_detention", "STPO:collusion_flight_risk"]
    assert tuple(one(spark, "laws", lambda c: U.quotas(c, 20, 20))) == (100, 20, 60, 20)
    assert tuple(one(spark, "laws", lambda c: U.quotas(c, 0, 0))) == (120, 0, 80, 0)
    assert tuple(one(spark, "laws", lambda c: U.quotas(c, 500, 500))) == (60, 60, 40, 40)


def test_error_taxonomy(spark):
    cases = [(0.0, 0.0, 0.0, 0, "total_miss"), (0.1, 0.5, 0.2, 1, "out_of_corpus_label"), (0.3, 0.5, 0.2, 0, "low_recall"), (0.3, 0.2, 0.5, 0, "low_precision"), (0.35, 0.35, 0.35, 0, "both_weak"), (0.6, 0.6, 0.6, 0, "stable")]
    df = spark.createDataFrame(cases, "f double, p double, r double, m int, label string")
    assert all(r.label == r.got for r in df.withColumn("got", T.error_taxonomy(F.col("f"), F.col("p"), F.col("r"), F.col("m"))).collect())
