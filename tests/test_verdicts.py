"""Decisions on candidates against cases and plain versions."""

import random
import re

from pyspark.sql import functions as F

from sparkloom.functions import validation as V
from sparkloom.functions import verdicts as J


def rows(spark, data, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_question_leaks(spark):
    data = [
        ("How fast did the ice grow?", ["fast"], True),
        ("How fast did the icefield grow?", ["ice"], False),
        ("Is it so, yes or no?", ["Yes", "no"], False),
        ("Was it 5.2 % of all?", ["5.2 %"], True),
        ("Was it 15.2 % of all?", ["5.2 %"], False),
        ("A (b) c\\E d", ["b c"], True),
        ("Yes, snow fell. It was late", ["snow fell it"], True),
        ("", ["a"], False),
        (None, ["a"], False),
        ("text", None, False),
        ("text", [None, ""], False),
        ("text", [], False),
        ("Straße bei Köln", ["köln"], True),
        ("Kölner Straße", ["köln"], False),
    ]
    got = rows(spark, [r[:2] for r in data], "q string, a array<string>", J.question_leak(F.col("q"), F.col("a")))
    assert got == [r[2] for r in data]


def test_question_leaks_against_a_plain_version(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "a", "b.", "a-b", "(a)", "1.5", "%", "+", "yes", "No,", "é", "a_b", "\n"])
    data = [(" ".join(word() for _ in range(rng.randrange(8))), [" ".join(word() for _ in range(rng.randrange(3))) for _ in range(2)]) for _ in range(400)]

    def plain(s):
        s = " ".join(s.lower().split())
        s = re.sub(r"[^\w%°.+\-−]+", " ", re.sub(r"^(?:yes|no)\s*[,;:]?\s+", "", s))
        return " ".join(s.replace(". ", " ").strip(".").split())

    want = [any(plain(a) not in ("", "yes", "no") and re.search(rf"(?<!\w){re.escape(plain(a))}(?!\w)", plain(q)) is not None for a in answers) for q, answers in data]
    assert rows(spark, data, "q string, a array<string>", J.question_leak(F.col("q"), F.col("a"))) == want
    assert 40 < sum(want) < 360


def test_context_leaks(spark):
    data = [
        ("the ice is thin", ["ice"], False),  # shorter than four characters
        ("the thin ice", ["thin ice"], True),
        ("in all 1,200 sites", ["1,200 m"], True),
        ("in all 1,2000 sites", ["1,200 m"], False),
        ("in 12 sites", ["x", "12"], False),  # numbers of the answer itself only
        ("in 12 sites", None, False),
        (None, ["12"], False),
        ("", ["12"], False),
    ]
    got = rows(spark, [r[:2] for r in data], "c string, a array<string>", J.context_leak(F.col("c"), F.col("a")))
    assert got == [r[2] for r in data]


def test_calendar_years(spark):
    data = [
        ("1999", "2008-2018", True), ("2011", "2012", True), ("2012", "spring", False), ("2010–2012", "in 2011", False), ("2012 to 2010", "2011", True),
        ("1800 to 2000", "1900", True), ("1850 until 2000", "1900", False), ("12012", "2013", False), (None, "2012", False), ("", "", False), ("1990 and 1995", "1993", False),
    ]
    assert rows(spark, [r[:2] for r in data], "l string, r string", J.scopes_contradict(F.col("l"), F.col("r"))) == [r[2] for r in data]
    years = rows(spark, [("2001 through 2003, 2002 and 1999",), (None,)], "t string", F.array_sort(J.calendar_years(F.col("t"))))
    assert years == [[1999, 2001, 2002, 2003], None]


def test_claim_types(spark):
    over, differ = "causal_overclaim", "question_claim_type_disagreement"
    data = [
        ("observation", "causal", "observation", [differ, over]), ("observation", "definition", "association", []), ("causal", "causal", "causal", []),
        ("association", "causal", "causal", [over]), ("definition", "causal", "definition", [differ]), ("observation", "causal", None, [over]), (None, None, None, []), ("causal", "causal", "other", []),
    ]
    got = rows(spark, [r[:3] for r in data], "a string, b string, c string", J.claim_type_reasons(F.col("a"), F.col("b"), F.col("c")))
    assert got == [r[3] for r in data]


def test_option_verdicts(spark):
    right = "option_correct_under_question_interpretation"
    data = [
        (None, True, True, True, False, None, "option_contradiction_unresolved"), (True, True, None, True, False, None, "option_standalone_uninterpretable"), (True, True, True, None, True, " ", "option_admission_unexplained"),
        (True, True, True, None, True, "so", right), (True, True, True, None, False, None, None), (True, False, None, None, True, None, "distractor_alternative_answer_possible"),
        (True, None, None, True, True, None, right), (True, False, None, True, False, "so", None),
    ]
    names = ("e", "n", "s", "a", "d", "r")
    got = rows(spark, [r[:6] for r in data], "e boolean, n boolean, s boolean, a boolean, d boolean, r string", J.option_verdict_reason(*map(F.col, names)))
    assert got == [r[6] for r in data]


def test_acronyms_of_compounds_and_versions(spark):
    texts = ["the Asian-Pacific Oscillation (APO)", "a Sea-Ice Model (SM) ran", "the Ice Ocean Model version 2.1 (IOM)", "called by the acronym XYZ here", "the XYZ was predicted", None]
    got = rows(spark, [(t,) for t in texts], "t string", V.unresolved_acronyms(F.col("t")))
    assert got[:4] == [[], [], [], []] and got[4] == ["XYZ"]


def test_uncertain_quantities(spark):
    data = [("13.0 ± 2.6 °C", "°C", ["13", "2.6"]), ("0.122 mm (sd = 0.04)", "mm", ["0.122", "0.04"]), ("5 +/- 1 m", "mm", []), ("1,200 + / - −3 m", "m", ["1200", "-3"]), ("5 ± 1 ms", "m", []), ("5 ± 1", "m", []), (None, "m", None), ("5 ± 1 m", None, None)]
    got = rows(spark, [r[:2] for r in data], "t string, u string", J.uncertain_quantities(F.col("t"), F.col("u")))
    assert [g and [f"{float(x):g}" for x in g] for g in got] == [r[2] for r in data]


def test_gate_and_evidence(spark):
    schema = "p boolean, r array<string>, h array<string>, d array<string>"
    data = [
        (False, ["undefined_x"], [" "], None, True), (False, ["undefined_x"], ["it"], None, False), (False, ["multiple_interpretations"], ["it"], ["a"], True), (False, ["multiple_interpretations"], None, ["a", "b"], False),
        (True, ["undefined_x"], None, None, False), (None, ["undefined_x"], None, None, False), (False, None, None, None, False),
    ]
    assert rows(spark, [r[:4] for r in data], schema, J.unevidenced(*map(F.col, "prhd"))) == [r[4] for r in data]
    gates = [(True, None, None, False, ["answer_leakage"]), (False, True, "rule", None, ["a", "a"]), (None, None, None, True, None)]
    got = rows(spark, gates, "q boolean, c boolean, r string, l boolean, j array<string>", J.gate_reasons(*map(F.col, "qcrlj")))
    assert got == [["question_answer_leakage", "standalone_answer_leakage"], ["question_context_answer_leakage", "rule", "standalone_a"], []]
