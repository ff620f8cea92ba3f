"""Closed sets and units against cases and plain versions."""

import random
import re

from pyspark.sql import functions as F

from sparkloom.functions import closed_sets as C

RULE = "struct<kind: string, source_values: array<string>, member_type: string, ordering: string>"
OPTION_RULE = "struct<kind: string, candidate_value: string, candidate_values: array<string>, member_type: string, ordering: string>"


def values(spark, rows, column, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(column).collect()]


MEMBERS = [
    ("alpha, beta, and gamma", ["alpha", "beta", "gamma"]),
    ("Taxa included the phylum Alpha followed by Beta > gamma.", ["alpha", "beta", "gamma"]),
    ("alpha then beta", ["alpha", "beta"]),
    ("ranked i.e. a and b", ["a", "b"]),
    ("alpha or beta, gamma", None),
    ("alpha; beta", None),
    ("alpha", None),
    ("alpha, , beta", None),
    ("species x and y", ["x", "y"]),
    ("", None),
    (None, None),
]


def test_members(spark):
    assert values(spark, [(a,) for a, _ in MEMBERS], C.members(F.col("t")), "t string") == [b for _, b in MEMBERS]
    rows = [("a or b", ["The genus A", " b."]), ("a and b", []), ("a and b", None), ("a and b", ["x"]), ("a and b", ["x", " "]), ("a and b", ["x", None])]
    got = values(spark, rows, C.members(F.col("t"), F.col("v")), "t string, v array<string>")
    assert got == [["a", "b"], ["a", "b"], ["a", "b"], None, None, None]


def test_binomials(spark):
    rows = [(["calanus glacialis", "c. hyperboreus", "x"],), (["calanus glacialis", "clione limacina"],), (["c. x", "d. y"],), ([],), (["calanus a", "calanus b", "c.c"],)]
    got = values(spark, rows, C.member_keys(F.col("v")), "v array<string>")
    assert got == [["calanus glacialis", "calanus hyperboreus", "x"], None, ["c. x", "d. y"], [], ["calanus a", "calanus b", "c.c"]]


SETS = [
    ("The sequence consists of alpha, beta, and gamma.", True),
    ("Exactly three taxa were alpha, beta, and gamma.", True),
    ("We saw 3 taxa, namely alpha, beta, and gamma.", True),
    ("Three taxa: alpha, beta, and gamma.", False),
    ("Examples include alpha, beta, and gamma.", False),
    ("Observed taxa included alpha, beta, and gamma.", False),
    ("It consists of much; exactly two: alpha, beta, and gamma.", False),
    ("It consists of alpha; beta and gamma too.", True),
    ("Exactly three taxa were alpha and beta.", False),
    (None, False),
]


def test_whole_sets(spark):
    got = values(spark, [(a,) for a, _ in SETS], C.states_whole_set(F.col("t"), F.array(F.lit("Alpha"), F.lit("beta"), F.lit("gamma"))), "t string")
    assert got == [b for _, b in SETS]


def test_contracts(spark):
    three = ["alpha", "beta", "gamma"]
    whole, ordered = "Exactly three taxa were alpha, beta, and gamma.", "The ordered sequence consists of alpha, beta, and gamma."

    def case(option, evidence=whole, ordering="unordered", typed=None, option_ordering=None, answer="alpha, beta, and gamma", kind="closed_set", source=three, member_type="categorical_value"):
        return (answer, evidence, (kind, source, member_type, ordering), option, ("closed_set", option, typed, None, option_ordering))

    swapped = ["beta", "alpha", "gamma"]
    cases = [
        (case("beta, alpha, and gamma", ordered, "ordered", swapped, "ordered"), (three, swapped, "ordered")),
        (case("beta, alpha, and gamma", typed=swapped), (three, swapped, "unordered")),
        (case("delta, beta, and gamma"), (three, ["delta", "beta", "gamma"], "unordered")),
        (case("beta, alpha, and gamma", ordered, "ordered", three), None),  # typed values are not what is shown
        (case("beta, alpha, and gamma", ordered, "ordered", swapped, "unordered"), None),
        (case("alpha, beta, and abundance increased", "Observed taxa included alpha, beta, and gamma."), None),
        (case("alpha and beta"), None),
        (case("alpha, alpha, and delta"), None),
        (case("alpha, beta, and delta", answer="alpha, beta, and epsilon"), None),
        (case("alpha, beta, and delta", kind="other"), None),
        (case("alpha, beta, and delta", member_type="quantity"), None),
        (case("alpha, beta, and delta", ordering="sorted"), None),
        (case("alpha, beta, and delta", source=["alpha"]), None),
        (case("alpha, beta, and delta", source=None), None),
        (case("alpha, beta, and delta", evidence=None), None),
    ]
    column = C.contract(*(F.col(c) for c in ("a", "e", "r", "o", "k")))
    got = values(spark, [c for c, _ in cases], column, f"a string, e string, r {RULE}, o string, k {OPTION_RULE}")
    assert [g and tuple(g) for g in got] == [w for _, w in cases]
    assert values(spark, [], column, f"a string, e string, r {RULE}, o string, k {OPTION_RULE}") == []


def plain_numeric(value):
    t = " ".join(value.lower().split())
    t = re.sub(r"\b(?:per\s*cent|percentage)\b", "%", t)
    for unit, names in C.UNITS.items():
        for name in names if unit != "%" else []:
            t = re.sub(rf"\b{name}\b", unit, t)
    for pattern, by in C.NUMERIC_WORDS[-8:]:
        t = re.sub(pattern.replace("(?U)", ""), by, t)
    return " ".join(t.split()).strip(".")


def test_numeric_texts_and_units(spark):
    rng = random.Random(8)
    pool = ["about", "5", "10-12", "per cent", "percentage", "%", "metres", "hrs", "more than", "≥", "3–4", "ice", "deg c", "d", "approx.", "less than", "(n=4)", "yr", "-2", "."]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(8))) for _ in range(400)]
    assert values(spark, [(t,) for t in texts], C.numeric_text(F.col("t")), "t string") == [plain_numeric(t) for t in texts]
    rows = [("Metres", "m", True), ("percent", "%", True), ("km", "m", False), ("Deg  C", "°C", True), ("", "", False), (None, "m", False), ("foo", "FOO", True), ("hrs", "hour", True)]
    assert values(spark, [r[:2] for r in rows], C.units_equal(F.col("a"), F.col("b")), "a string, b string") == [r[2] for r in rows]
