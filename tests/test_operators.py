"""Gates, merges, text helpers, sources, sinks and streams on small inputs."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkloom.functions import ids, text
from sparkloom.operators import ledger, lookups, prefilter
from sparkloom.sources import files, sinks
from sparkloom.streaming import jobs

KV = StructType([StructField("k", LongType()), StructField("v", StringType())])


def test_gate_names_itself(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], KV)
    with pytest.raises(PySparkException, match="keys repeat"):
        lookups.must_be_empty(lookups.duplicate_keys(df, "k"), "keys repeat").collect()
    assert lookups.must_be_empty(lookups.duplicate_keys(df.limit(1), "k"), "keys repeat").first()[0] == 0


def test_overlay_and_insert(spark):
    base, new = spark.createDataFrame([(1, "a"), (2, None)], KV), spark.createDataFrame([(1, None), (2, "x"), (3, "y"), (3, "z")], KV)
    assert sorted(lookups.overlay(base, new.filter("k < 3"), "k", ["v"]).collect()) == [(1, "a"), (2, "x")]
    assert sorted(lookups.insert_or_ignore(base, new, "k", F.col("v")).collect(), key=str) == [(1, "a"), (2, None), (3, "y")]


def test_replay_is_idempotent(spark):
    snapshot = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, value string")
    journal = spark.createDataFrame([(5, "a", "9"), (6, "b", None), (4, "c", "old"), (7, "d", "new")], "seq long, k string, value string")
    want = {"a": "9", "d": "new"}
    assert dict(map(tuple, ledger.replay(snapshot, journal.filter("seq > 4"), "k", 4).collect())) == want
    assert dict(map(tuple, ledger.replay(snapshot, journal.union(journal), "k", 4).collect())) == want


def test_session_gap_of_exactly_the_limit_joins(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:07:00"), (1, "2024-01-01 00:14:01")]
    e = spark.createDataFrame(rows, "k long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(r["events"] for r in ledger.sessions(e, ["k"], "ts", 420).collect()) == [1, 2]


def test_money(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "s string").select(ledger.money(F.col("s")).alias("m"))
    assert [float(r["m"]) for r in df.collect()] == [1.5, 0.0, 0.0]


def test_classification(spark):
    rows = [
        ("seed", "JournalArticle", ["collaborator_seed:x"], "priority_seed"),
        ("review", "Review", ["s:1"], "flagged_nonresearch_type"),
        ("mixed", "JournalArticle;Review", ["s:1"], "unresolved_mixed_type"),
        ("none", None, None, "unresolved_missing_type"),
        ("article", "journal-article", ["s:1"], "retained_article_type"),
        ("other", "Conference", ["s:1"], "unresolved_other_type"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "candidate_key string, type string, origins array<string>")
    for c in ("doi", "stable_id", "venue", "landing_url", "open_access_url", "year"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = prefilter.classify(df)
    assert {r["candidate_key"]: r["disposition"] for r in got.collect()} == {r[0]: r[3] for r in rows}
    assert got.filter("identity <> 'missing_identity' or access <> 'no_access_url'").isEmpty()


def test_title_terms_are_whole_words(spark):
    df = spark.createDataFrame([("The  North Slope of Greenlandic ice",)], "t string")
    assert df.select(prefilter.title_terms(F.col("t"), ["north slope", "greenland"])).first()[0] == ["north slope"]


def test_texts(spark):
    df = spark.createDataFrame([("x-api-key: abc, Bearer  tok sk-abcdefgh1",)], "t string")
    assert df.select(text.redact(F.col("t"))).first()[0] == "x-api-key: [REDACTED], Bearer  [REDACTED] [REDACTED]"
    doi = spark.createDataFrame([(" https://doi.org/10.1/AB. ",), ("doi:10.2/x y",), ("11.1/x",), (None,)], "t string")
    assert [r[0] for r in doi.select(text.normalize_doi(F.col("t"))).collect()] == ["10.1/ab", None, None, None]
    y = spark.createDataFrame([("from 1998-2001 and 2010",)], "t string")
    assert y.select(text.years(F.col("t"))).first()[0] == [1998, 1999, 2000, 2001, 2010]


def test_sentences_and_chunks():
    t = "One et al. two. Three fig. 4!\nFive"
    assert [t[a:b] for a, b in text.sentence_spans(t)] == ["One et al. two.", "Three fig. 4!", "Five"]
    t = 'See Vol. 3 and prof. Lee. "Done." Then e.g. this. 1. marker\n2. Two. A. Smith went. ok then. lower (Fig. 2).'
    assert [t[a:b] for a, b in text.sentence_spans(t)] == ["See Vol. 3 and prof. Lee.", '"Done."', "Then e.g. this.", "1. marker", "2. Two.", "A. Smith went. ok then. lower (Fig. 2)."]
    spans = [(i * 10, i * 10 + 9) for i in range(10)]
    chunks = text.pack_chunks(spans, 30, 9)
    assert chunks[:3] == [(0, 29, 0, True), (20, 49, 9, True), (40, 69, 9, True)] and chunks[-1][1] == 99
    assert text.pack_chunks([(0, 5), (6, 30), (31, 35)], 10, 0) == [(0, 5, 0, True), (6, 16, 0, False), (16, 26, 0, False), (26, 30, 0, False), (31, 35, 0, True)]


def test_sentences_of_a_very_long_text():
    import time

    began = time.time()
    assert len(text.sentence_spans("This is one more sentence of the text. " * 60_000)) == 60_000
    assert time.time() - began < 20


def test_orders(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["c", "a", "b"])], "v array<string>, o array<string>")
    assert df.select(ids.apply_order(F.col("v"), F.col("o"))).first()[0] == ["c", "a", "b"]
    assert df.select(ids.apply_order(F.array(F.lit("z")), F.col("o"))).first()[0] is None
    assert sorted(df.select(ids.seeded_order(F.col("v"), "p", F.lit("s"))).first()[0]) == ["a", "b", "c"]
    assert ids.letter_list(2) == "A or B" and ids.letter_list(4) == "A, B, C, or D"


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": 1, "v": "a"}\n\n{"k": 2}\n')
    assert files.jsonl(spark, str(tmp_path / "x.jsonl"), KV).count() == 2
    assert files.jsonl(spark, str(tmp_path / "none.jsonl"), KV, absent_is_empty=True).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v"')
    with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
        files.jsonl(spark, str(tmp_path / "bad.jsonl"), KV, strict=True).collect()
    assert files.journal(spark, str(tmp_path / "bad.jsonl"), KV).select("k").collect() == [(1,)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "ä")], KV)
    sinks.write_jsonl(df, str(tmp_path / "out"), F.col("k"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines, key=lambda x: x["k"]) == [{"k": 1, "v": "ä"}, {"k": 2, "v": None}]
    path = str(tmp_path / "once")
    assert sinks.write_once(df, path, F.col("k")) and not sinks.write_once(df, path, F.col("k"))
    with pytest.raises(FileExistsError):
        sinks.write_once(df.limit(1), path, F.col("k"))
    assert sinks.digest(df).first() == sinks.digest(df.orderBy("k")).first()
    assert sinks.markdown(df.orderBy("k")).splitlines()[2] == "| 1 | ä |"


def test_sections():
    html = "<nav>x</nav><p>lead</p><h1>One <b>two</b></h1><p>a &amp; b<br>c<script>no</script>"
    assert list(files.sections_of(html)) == [(0, "", "lead"), (1, "One two", "a & b\nc")]


def test_upserts_in_batches(spark, tmp_path):
    for i, rows in enumerate(([(1, "a", 1), (2, "b", 1)], [(1, "c", 2)], [(2, "old", 0)])):
        spark.createDataFrame(rows, "k long, v string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_table(spark, str(tmp_path / "in"))
    got = jobs.upsert_batches(stream, str(tmp_path / "work"), "k", "n")
    assert {r["k"]: r["v"] for r in got.collect()} == {1: "c", 2: "b"}


def test_library_does_not_need_the_llm_folder():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "sparkloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "sparkloom.llm" in p.read_text()]
