"""Checks of displayed texts, provider records, layout and journals against cases and plain versions."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import ids as I
from sparkloom.functions import validation as V
from sparkloom.operators import layout, lookups
from sparkloom.sources import files, providers, sinks


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_malformed_texts(spark):
    nine = " ".join("word" for _ in range(9))
    texts = ["fine", "a\nb", "a   b", "a  b", f'he said "{nine}" so', 'he said "one two"', None, "", "a\t\t\tb"]
    assert values(spark, texts, V.malformed) == [False, True, True, False, True, False, False, False, True]


def test_assertions_in_ascii(spark):
    """With ASCII alone a word ends before an accented letter, as in the SQL of assertion_issues."""
    texts = ["No\u00f1asc", "se\u00f1or", "followed\u00a0by", "\u0130f", "nothing", "a\tnot b", None]
    negated, compound = "displayed_assertion_negated", "displayed_assertion_compound"
    assert values(spark, texts, lambda t: V.assertion_issue(t, ascii_only=True)) == [negated, compound, None, compound, None, negated, None]


def test_assertions(spark):
    texts = ["Ice grew", "Ice did not grow", "Ice; snow", "Ice and snow", "rain Followed  by snow", "Nothing android orbits"]
    assert values(spark, texts, V.assertion_issue) == [None, "displayed_assertion_negated", *["displayed_assertion_compound"] * 3, None]


def test_quantities(spark):
    rows = [("1 km", "1", "km"), ("about 1.5 km or 2 km", "1.5", "km"), ("four sites", "4", "sites"), ("3 to 4 m", "3", "m"), ("5 m", "6", "m"), ("−7 °C", "-7", "°C"), ("5 miles", "5", "m"), ("5 m", "x", "m"), ("5 m", "5", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, v string, u string").select(V.numeric_display_issue(F.col("t"), F.col("v"), F.col("u"))).collect()]
    ambiguous, scalar = "numeric_display_ambiguous", "numeric_metadata_not_scalar"
    assert got == [None, ambiguous, None, ambiguous, "numeric_metadata_display_mismatch", None, ambiguous, scalar, scalar]
    rows = [("100", "cm", "0", "1", "m", True), ("0", "c", "0", "273.15", "K", True), ("1", "kg", "0.5", "1600", "g", False), ("1", "m", "9", "1", "kg", False), ("5", "h", "1", "6", "H", True)]
    got = spark.createDataFrame([r[:5] for r in rows], "a string, au string, t string, b string, bu string").select(V.numeric_equal(*(F.col(c) for c in ("a", "au", "t", "b", "bu")))).collect()
    assert [r[0] for r in got] == [r[5] for r in rows]


def test_redacted_locators(spark):
    texts = ["Ice grew (Figure 1).", "Ice grew [8], and snow [3, 4] too .", "Ice (thin) grew (Smith et al., 2012).", "As (see Table S2 for more) shown  here", "()", "Ice (in (old) days) grew"]
    assert values(spark, texts, V.redact_locators) == ["Ice grew.", "Ice grew, and snow too.", "Ice (thin) grew.", "As shown here", "", "Ice (in (old) days) grew"]
    texts = ["Stations were sampled in May [3].", "Table 2 lists what was there today.", "Too short.", "Column one was here        and two was there."]
    assert values(spark, texts, V.context_display) == ["Stations were sampled in May.", None, None, None]


def test_acronyms(spark):
    texts = ["The North Slope of Alaska (NSA) warmed", "NSA warmed", "NSA (North Slope Alaska) warmed", "NSA stands for a place", "a site known as NSA", "CO2 and DNA rose", "DBO3 was cold"]
    assert values(spark, texts, V.unresolved_acronyms) == [[], ["NSA"], [], [], [], [], ["DBO3"]]


def test_provider_records(spark):
    work = {"DOI": "10.1/A.", "title": [" T "], "author": [{"given": "A", "family": "B", "ORCID": None}], "published": {"date-parts": [[2001, 3, 9]]}, "subject": ["sea"], "reference": [{"DOI": "10.1/b"}, {}, {"DOI": "10.1/none"}]}
    other = {"DOI": "10.1/b", "URL": "u", "license": [{"URL": "l"}]}
    m = spark.createDataFrame([(json.dumps(work),), (json.dumps(other),)], "message string")
    a, b = providers.crossref_records(m).orderBy("doi").collect()
    assert (a["doi"], a["title"], a["authors"], a["published_date"], a["year"], a["discipline"]) == ("10.1/a", "T", ["A B"], "2001-03-09", 2001, "sea")
    assert (b["title"], b["license"], b["published_date"], b["authors"]) == ("Untitled", "l", None, []) and a["source_id"].startswith("src-")
    assert [(r["parent_doi"], r["doi"], r["reference_depth"]) for r in providers.reference_expansion(m, 5).collect()] == [("10.1/a", "10.1/b", 1)]
    with pytest.raises(Exception, match="requires doi or stable_id"):
        providers.crossref_records(spark.createDataFrame([('{"title": ["T"]}',)], "message string")).collect()


def test_articles(spark):
    xml = "<a xmlns='u'><front/><body><sec><title>Methods</title><p>We  did.</p></sec></body></a>"
    rows = providers.xml_sections(spark.createDataFrame([(1, xml), (2, "<a>only text</a>"), (3, None)], "id long, xml string"), "id").orderBy("id", "place").collect()
    assert [(r["id"], r["heading"], r["level"], r["text"]) for r in rows] == [(1, "body", 1, "Methods We did."), (1, "Methods", 1, "Methods We did."), (1, "p", 2, "We did."), (2, "Document", 0, "only text")]


def page(spark, lines):
    rows = [(1, p, float(x0), float(x1), float(y0), float(y0 + 10), t, 600.0, 800.0) for p, x0, x1, y0, t in lines]
    return spark.createDataFrame(rows, "doc_id long, page int, x0 double, x1 double, y0 double, y1 double, text string, page_width double, page_height double")


def test_reading_order(spark):
    left = [(0, 50, 280, 200 + 12 * i, f"left {i} goes on") for i in range(4)]
    right = [(0, 320, 550, 200 + 12 * i, t) for i, t in enumerate(["right col-", "umn here", "and Mid-", "West now"])]
    found = layout.blocks(page(spark, [*right, (0, 50, 550, 120, "A title across"), *left])).orderBy("place").collect()
    assert [r["text"] for r in found] == ["A title across", "left 0 goes on left 1 goes on left 2 goes on left 3 goes on", "right column here and Mid- West now"]
    assert found[1]["line_count"] == 4


def test_pages_across_batches(spark):
    """Many pages come in one batch and a page may go on in the next one."""
    import pyarrow as pa

    rows = [layout.Line(d, p, 50.0, 550.0, 100.0 + 40 * i, 110.0 + 40 * i, f"{d} {p} {i}", 600.0, 800.0) for d in (1, None) for p in range(5) for i in range(7)]
    columns = {c: [getattr(r, c) for r in rows] for c in layout.Line._fields}
    whole = pa.RecordBatch.from_pydict(columns)
    for size in (1, 4, 9, 70):
        got = [r for b in layout._pages(iter([whole.slice(k, size) for k in range(0, len(rows), size)])) for r in b.to_pylist()]
        assert [(r["doc_id"], r["page"], r["place"], r["text"]) for r in got] == [(r.doc_id, r.page, i % 7, r.text) for i, r in enumerate(rows)]
    lines = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(layout.Line._fields, "long int double double double double string double double".split())))
    assert layout.blocks(lines).count() == len(rows)
    assert layout.with_running_heads(layout.blocks(lines)).filter("running").count() == 0


def test_running_heads_and_sections(spark):
    lines = []
    for p in range(4):
        lines += [(p, 50, 550, 10, f"Journal of Ice {p}"), (p, 50, 550, 770, "odd note" if p == 1 else f"Page {p}")]
        lines += [(p, 50, 550, 200, "1. Introduction" if p == 0 else "Methods" if p == 2 else "Some text."), (p, 50, 550, 300, "2.1 Deeper" if p == 2 else "body text.")]
    kept = layout.drop_running_heads(layout.blocks(page(spark, lines)))
    assert sorted(r["text"] for r in kept.collect() if "Journal" in r["text"] or "age" in r["text"] or "odd" in r["text"]) == ["odd note"]
    rows = layout.sections(kept).orderBy("section").collect()
    assert [(r["heading"], r["level"], list(r["heading_path"])) for r in rows] == [("Introduction", 1, ["Introduction"]), ("Methods", 1, ["Methods"]), ("Deeper", 2, ["Methods", "Deeper"])]


def test_journal_order_and_torn_tail(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("k", LongType())])
    whole = "".join(f'{{"k": {i}}}\n' for i in range(500)) + "\n"
    (tmp_path / "torn.jsonl").write_text(whole + '{"k": 5')
    (tmp_path / "broken.jsonl").write_text('{"k": 0}\n[1]\n' + whole)
    for only in (False, True):
        rows = files.journal(spark, str(tmp_path / "torn.jsonl"), schema, only_torn_tail=only).orderBy("ord").collect()
        assert [r["k"] for r in rows] == list(range(500))
    assert files.journal(spark, str(tmp_path / "broken.jsonl"), schema).count() == 501
    with pytest.raises(Exception, match="broken"):
        files.journal(spark, str(tmp_path / "broken.jsonl"), schema, only_torn_tail=True).collect()


def test_positions(spark):
    rows = [((i * 7919) % 5003,) for i in range(5003)]
    got = lookups.positions(spark.createDataFrame(rows, "v long").repartition(5), F.struct((-F.col("v")).alias("v")), "at", parts=9, sample=100).collect()
    assert {r["v"]: r["at"] for r in got} == {v: 5003 - v for v in range(5003)}
    assert lookups.positions(spark.createDataFrame([], "v long"), F.col("v")).count() == 0


def test_links_and_headings(spark):
    html = "<A class='x' HREF='one'>1</A><a href=\"two\">2</a><link href='no'><h1 class=\"t\">A <b>b</b></h1>"
    row = spark.createDataFrame([(html,)], "h string").select(files.links(F.col("h")), files.heading(F.col("h"))).first()
    assert row[0] == ["one", "two"] and re.sub(r"\s+", " ", row[1]) == "A b"


def test_reports_are_whole_or_an_error(spark):
    with pytest.raises(ValueError, match="more than 3"):
        sinks.markdown(spark.range(4), most=3)
    assert sinks.markdown(spark.range(3), most=3).count("\n") == 5


def test_fair_waves_across_batches():
    import pandas as pd
    import pyarrow as pa

    from sparkloom.plans.evaluation import family_waves, waves

    rows = [(f, f"m{(k * 7 + f) % 5}", k) for f in range(6) for k in range(f * 40, f * 40 + 3 + 5 * f)]
    table = pd.DataFrame(rows, columns=["family", "model", "request_key"])
    want = {tuple(r) for _, g in table.groupby("family") for r in waves(g, 4).itertuples(index=False)}
    whole = pa.RecordBatch.from_pandas(table)
    for size in (1, 7, 500):
        got = [tuple(r.values()) for b in family_waves(iter([whole.slice(k, size) for k in range(0, len(rows), size)]), 4) for r in b.to_pylist()]
        assert set(got) == want and len(got) == len(rows)


def test_fair_waves():
    import random

    import pandas as pd

    from sparkloom.plans.evaluation import waves

    rng = random.Random(3)
    for _ in range(60):
        slots, rows = rng.randrange(1, 6), [(f"k{i:02}", f"m{rng.randrange(4)}") for i in range(rng.randrange(1, 30))]
        got = dict(waves(pd.DataFrame(rows, columns=["request_key", "model"]), slots).values.tolist())
        left, want, wave = {m: sorted(k for k, v in rows if v == m) for _, m in rows}, {}, 0
        while left:
            share, free = -(-slots // len(left)), slots
            for m in sorted(left, key=lambda m: (len(left[m]), m)):
                for _ in range(min(share, free, len(left[m]))):
                    want[left[m].pop(0)] = wave
                    free -= 1
            left = {m: k for m, k in left.items() if k}
            wave += 1
        assert got == want and all(list(got.values()).count(w) <= slots for w in got.values())


def test_compatibility_forms(spark):
    import unicodedata

    from sparkloom.functions import text

    texts = ["ﬁ ﬃ ½ Å", "so\u00adft", None, "", "plain", "㎏ ①"]
    assert values(spark, texts, lambda c: text.nfkc(c)) == [t and unicodedata.normalize("NFKC", t).replace("\u00ad", "") for t in texts]


def test_contexts_of_a_long_text(spark, tmp_path):
    from sparkloom.plans.validation import resolved_contexts

    rows = [(1, "Ice grew [3] été. " * 60_000), (2, "POC rose 🜁.\n Snow fell (Fig. 2). "), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = [tuple(r) for r in resolved_contexts(spark, str(tmp_path)).collect()]
    assert time.time() - began < 20  # over a minute when each sentence was looked for from the begin of its text
    assert sorted(start for doc, start, _, _ in got if doc == 1) == list(range(0, 18 * 60_000, 18))
    want = [s for s, in spark.createDataFrame([("Ice grew été.",), ("POC rose 🜁.",), ("Snow fell.",)], "t string").select(I.stable_id("context", F.col("t"))).collect()]
    assert {(shown, n) for doc, _, shown, n in got if doc == 1} == {(want[0], 0)}
    assert sorted(r for r in got if r[0] != 1) == [(2, 0, want[1], 1), (2, 13, want[2], 0)]
