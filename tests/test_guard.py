"""Decisions, expected questions, pauses, texts within a budget and extraction measures, on cases worked out by hand."""

from decimal import Decimal

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import guard as G

MET = dict.fromkeys(G.CRITERIA, "satisfied")


def test_decisions(spark):
    rows = [
        (MET, "eligible", ["all_required_criteria_satisfied"], False),
        (MET | {"correction_retraction_coverage": "uncertain"}, "eligible", ["all_required_criteria_satisfied"], False),
        (MET | {"study_geography": "uncertain"}, "uncertain", ["criterion_unresolved:study_geography"], True),
        (MET | {"study_geography": "failed"}, "excluded", ["criterion_failed:study_geography"], False),
        (MET | {"study_geography": "uncertain", "access_rights_evidence": None}, "uncertain", ["criterion_unresolved:access_rights_evidence", "criterion_unresolved:study_geography"], False),
        (MET | {"study_geography": "uncertain", "correction_retraction_coverage": "failed"}, "excluded", ["criterion_failed:correction_retraction_coverage"], False),
        ({}, "uncertain", [f"criterion_unresolved:{c}" for c in sorted(G.CRITERIA)], False),
        (None, "uncertain", [f"criterion_unresolved:{c}" for c in sorted(G.CRITERIA)], False),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, s map<string, string>")
    got = df.orderBy("i").select(G.decision(F.col("s")).alias("d"), G.rescreen_eligible(F.col("s")).alias("r")).collect()
    assert [(g["d"]["decision"], g["d"]["reasons"], g["r"]) for g in got] == [r[1:] for r in rows]


def test_expected_questions(spark):
    rows = [  # accepted, allocation, spent, evaluated, target
        ((10, "100", "25", 4, None), (Decimal("75"), Decimal("2.5"), 30, "allocation", 40, 36)),
        ((10, "100", "25", 4, 20), (Decimal("75"), Decimal("2.5"), 30, "accepted_question_target", 20, 16)),
        ((10, "100", "25", 50, 5), (Decimal("75"), Decimal("2.5"), 30, "accepted_question_target", 10, 0)),
        ((10, "20", "25", 0, 0), (Decimal("0"), Decimal("2.5"), 0, "allocation", 10, 10)),
        ((0, "100", "25", 0, None), (Decimal("75"), None, 0, "allocation", 0, 0)),
        ((-3, "100", None, None, None), (Decimal("100"), None, 0, "allocation", 0, 0)),
        ((3, "7", "3", 0, None), (Decimal("4"), Decimal("1"), 4, "allocation", 7, 7)),
    ]
    df = spark.createDataFrame([(i, *r[0]) for i, r in enumerate(rows)], "i int, a long, m string, s string, e long, t long")
    out = G.expected_questions(F.col("a"), F.col("m").cast("decimal(18,6)"), F.col("s").cast("decimal(18,6)"), F.col("e"), F.col("t"))
    got = df.orderBy("i").select(*[c.alias(n) for n, c in out.items()]).collect()
    assert [tuple(g) for g in got] == [r[1] for r in rows]


def test_extrapolation(spark):
    df = spark.createDataFrame([(0, "10", 4, 6), (1, "10", 0, 6), (2, "1", 3, 1), (3, None, 3, -1), (4, "0.000001", 2, 1)], "i int, s string, e long, f long")
    out = G.extrapolated(F.col("s").cast("decimal(18,6)"), F.col("e"), F.col("f"))
    got = [tuple(r) for r in df.orderBy("i").select(*out.values()).collect()]
    assert got == [(Decimal("2.5"), Decimal("25")), (None, None), (Decimal("0.333333"), Decimal("1.333333")), (Decimal("0"), Decimal("0")), (Decimal("0"), Decimal("0.000002"))]


def test_pauses(spark):
    rows = [("v", "b", 2.0, False), ("v", "a", 2.0, None), ("v", "z", 9.0, True), ("w", "x", None, False), ("w", "y", 0.0, False), ("u", "q", 1.0, True), ("n", "only", None, None), ("n", None, 5.0, False)]
    readings = spark.createDataFrame(rows, "vendor string, model string, usd_per_question double, paused boolean")
    assert {tuple(r) for r in G.pause_choice(readings).collect()} == {("v", "a"), ("w", "y"), ("n", "only")}
    assert G.pause_choice(readings.limit(0)).collect() == []


def test_state_texts(spark):
    body, long = "x" * 900, "y" * 3000
    texts = [
        None, "", body, f"{body}\nReferences\n" + "r" * 500, f"{long}\n 7. Works  cited", f"{long}\n7) works cited : \nz\nBIBLIOGRAPHY\nq", f"References\n{long}",
        f"{long}\nreferences are many", "я" * 3000, long,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(T.references_start(F.col("t"))).collect()] == [None, 0, 900, 901, len(texts[4]), len(texts[5]) - 14, len(texts[6]), len(texts[7]), 3000, 3000]
    got = [r[0] for r in df.select(T.state_text(F.col("t"), 250)).collect()]
    trimmed = texts[5][: len(texts[5]) - 14]
    assert got[0] is None and [g["rule"] for g in got[1:]] == ["whole", "whole", "references_trimmed", "head_tail", "references_trimmed_head_tail", *["head_tail"] * 4]
    assert got[3]["state"] == texts[3][:901] and got[5]["state"] == trimmed[:600] + T.ELISION + trimmed[-400:]
    assert got[8]["state"] == "я" * 600 + T.ELISION + "я" * 400


def test_state_text_of_millions_of_characters(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("some words\n"), 300_000), F.lit("References\nz")).alias("t"))
    assert df.select(T.references_start(F.col("t"))).first()[0] == 3_300_000


def test_extraction_measures(spark):
    texts = ["one.   Two\n\n  \ncut-\nword Cut-\nWord co­op ﬁn", None, "", "a\r\nb\x85c d\x0b", "5-\nx é‐\nx _-\nx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [tuple(r) for r in df.select(*T.extraction_measures(F.col("t")).values()).collect()]
    words = [len(t.split()) if t is not None else None for t in texts]
    assert [g[5] for g in got] == words
    assert [g[1:4] for g in (got[0], got[4])] == [(1, 1, 2), (0, 1, 0)]
    assert [g[0] for g in got[2:4]] == [0, 4] and got[0][0] == 4
