"""What a reader sees: windows and initials against plain versions, contexts against cases."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import display as D
from sparkloom.functions import validation as V
from sparkloom.functions.text import once
from sparkloom.plans import ORACLE, QUERIES


def values(spark, rows, column, schema="a string, b string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(column).collect()]


PHRASES = [
    ("four chronosequences", "the four glacier foreland chronosequences", True),
    ("adult females", "adult males and females", False),
    ("adult females", "adult, and old, females", False),
    ("summer 2010", "in the summer of 2010.", True),
    ("summer Oscillation", "the summer Asian-Pacific Oscillation (APO) rose", True),
    ("summer rise", "the summer Oscillation (APO) rise", True),
    ("summer rise", "the summer Oscillation (so named) rise", False),
    ("ice grew", "ice. Grew", False),
    ("ice grew", "ice v. grew", True),
    ("PM 10", "PM10 rose", True),
    ("well-known", "well–known", True),
    ("snow cover", "snow-\ncover", False),
    ("snowcover", "snow-\ncover", True),
    ("or ice", "much ice", True),
    ("Straße", "die STRASSE", True),
    ("of the", "a of a the", False),
    ("", "x", False),
    (None, "x", False),
    ("x", None, False),
    ("x", "", False),
]


def test_phrases_without_units(spark):
    """Units stay apart where they are not asked for: the words of the phrase are the words of the text."""
    rows = spark.createDataFrame([("Licensed under CC BY-NC 4.0. Der.", "BY NC"), ("Und. Die 19 73 des", "Die 19 73")], "t string, p string")
    apart = D.in_window(D.content(F.col("p"), units=False), D.tokens(F.col("t"), units=False))
    assert [r[0] for r in rows.select(apart).collect()] == [True, True]
    assert [r[0] for r in rows.select(D.in_window(D.content(F.col("p")), D.tokens(F.col("t")))).collect()] == [False, True]


def test_displayed_phrases(spark):
    got = values(spark, [r[:2] for r in PHRASES], D.is_displayed(F.col("a"), F.col("b")))
    assert got == [r[2] for r in PHRASES]


def plain_window(needed, shown):
    bound = 2 * len(needed) + 2
    for s in range(len(shown)):
        place, k = s, 0
        while place < min(len(shown), s + bound) and k < len(needed) and (shown[place] != D.BOUNDARY) and (k or shown[place] == needed[0]):
            k += shown[place] == needed[k]
            place += 1
        if k == len(needed):
            return True
    return False


def test_windows_against_a_plain_walk(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        alphabet = "abcd"[: rng.randrange(2, 5)]
        rows.append((" ".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))), " ".join(rng.choice(alphabet + "xyz|") for _ in range(rng.randrange(25)))))
    got = values(spark, rows, once(F.split("b", " "), lambda t: D.in_window(F.split("a", " "), t)))
    assert got == [plain_window(a.split(), b.split()) for a, b in rows] and 100 < sum(got) < 1400


def plain_initials(words, letters):
    def ends(w, k):
        if k == 0:
            return True
        if not w:
            return False
        word = w[-1].lower()
        parts = [p for p in re.split("[-/]", word) if p]
        n = len(parts)
        return (
            word in D.GLUE_WORDS and ends(w[:-1], k)
            or word[0] == letters[k - 1] and ends(w[:-1], k - 1)
            or n > 1 and k >= n and [p[0] for p in parts] == list(letters[k - n : k]) and ends(w[:-1], k - n)
        )

    return ends(words[-(2 * len(letters) + 4) :], len(letters))


def test_initials_against_a_plain_alignment(spark):
    rng = random.Random(4)
    pool = ["ice", "Sea", "of", "the", "at", "a", "to", "Asian-Pacific", "in/out", "and", "Index", "a-b-c"]
    rows = []
    for _ in range(1500):
        words = [rng.choice(pool) for _ in range(rng.randrange(1, 8))]
        letters = "".join(w[0].lower() for w in words if rng.random() < 0.8) if rng.random() < 0.7 else "".join(rng.choice("isoatpc") for _ in range(rng.randrange(1, 6)))
        rows.append((" ".join(words), letters or "i"))
    got = values(spark, rows, D.initials_match(F.split("a", " "), F.col("b")))
    assert got == [plain_initials(a.split(), b) for a, b in rows] and 300 < sum(got) < 1300


ACRONYMS = [
    ("University at Buffalo (UB) warmed", []),
    ("the Area to Volume Index (AVI) rose", []),
    ("summer Asian-Pacific Oscillation (APO)", []),
    ("Pan-Arctic Ice-Ocean Modeling and Assimilation System (PIOMAS)", []),
    ("Community Earth System Model version 2 (CESM2) and CESM2", []),
    ("Community Earth System Model ver. 2 (CESM2)", []),
    ("Model Two 2 (MT2)", []),
    ("Atmospheric Radiation Measurement North Slope of Alaska (ARM NSA)", []),
    ("Ice Nucleating Particle (INP) and the Sea Ice Cover (SIC)", []),
    ("NSA warmed", ["NSA"]),
    ("TEM (transmission electron microscope)", []),
    ("the bla TEM gene", []),
    ("DBO3 was seen in CO2", ["DBO3"]),
    ("a thing (ABC) and XYZ", ["ABC", "XYZ"]),
    ("first-year ice is abbreviated as FYI", []),
    ("POC means particulate carbon", []),
    ("", []),
]


def test_acronyms(spark):
    assert values(spark, [(a, "") for a, _ in ACRONYMS], D.unresolved_acronyms(F.col("a"))) == [b for _, b in ACRONYMS]
    assert values(spark, [(None, "")], D.unresolved_acronyms(F.col("a"))) == [None]


#: Openings in which a verb or a prefix defines the letters, or a version stands before the brackets; then others, one with a known token.
OPENINGS = ["Hean are ered the. Antith inates", "Ache termed aat over town", "Old van OOT by truck", "ache is the best of", "Ice grew on the rev2. Then", "Ice grew on the v2", "a v1 b v2 c v3"]
OPENINGS += ["Red old new big air", "of the sea and of", "Straße und Eis, étang 5 mers", "one two three four", "", None]


def test_spelled_out_as_in_sql(spark, tmp_path):
    rows = [(i, text) for i, text in enumerate(OPENINGS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(ORACLE["spelled_out_acronyms"])
    got = QUERIES["spelled_out_acronyms"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


CONTEXTS = [
    ("According to the study (DOI: 10.1/example), how did FeA change?", "FeA is iron in Kongsfjorden sediment.", "source_dependent_locator"),
    ("During what period were peak POC and TPM fluxes recorded at DBO4?", "", "question_context_missing"),
    ("What was measured at the southern station (74.5 °N)?", "The southern station was at 74.5 °N.", "question_context_referent_unresolved"),
    ("What was measured at the southern station?", "The southern station lay in Kongsfjorden.", None),
    ("In the reported table on Page 3, what value appears for NS?", "", "source_dependent_locator"),
    ("What happened to (POC) flux?", "", "question_context_missing"),
    ("What happened to (POC) flux?", "POC rose in Kongsfjorden.", "question_context_referent_unresolved"),
    ("What happened to (POC) flux?", "POC means particulate organic carbon in Kongsfjorden.", None),
    ("What happened to particulate organic carbon (POC) flux?", None, None),
    ("Where did C. glacialis live?", " ", "question_context_missing"),
    ("Which DNA lineage had the highest CO2 response?", "", None),
    ("What grew?", "The XYZ site.", None),
    ("a\nb", "", "benchmark_text_malformed"),
    (None, None, None),
]


def test_contexts(spark):
    assert values(spark, [r[:2] for r in CONTEXTS], V.context_reason(F.col("a"), F.col("b"))) == [r[2] for r in CONTEXTS]


def test_quantities_that_are_no_numbers(spark):
    rows = [("abc", "m"), ("1" * 40, "m"), (None, "m"), ("9" * 25, "km"), ("1e3", "m"), ("", "m")]
    got = values(spark, rows, V.numeric_equal(F.lit("1"), F.lit("m"), F.lit("0"), F.col("a"), F.col("b")))
    assert got == [False] * len(rows)
    assert values(spark, [("x", "m")], V.numeric_equal(F.col("a"), F.lit("m"), F.lit("0"), F.lit("1"), F.col("b"))) == [False]
    assert values(spark, [("Temperature increased by two degrees in summer.", "")], V.context_display(F.col("a"))) == ["Temperature increased by two degrees in summer."]


def test_no_rows(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert none.select(D.is_displayed(F.col("a"), F.col("b")), D.unresolved_acronyms(F.col("a"))).collect() == []


@pytest.mark.parametrize("n", [20_000])
def test_long_texts(spark, n):
    text = "ice grew on the sea, and " * n + "snow cover"
    assert values(spark, [("snow cover", text), ("ice sea", text), ("sea snow", text)], D.is_displayed(F.col("a"), F.col("b"))) == [True, True, False]
