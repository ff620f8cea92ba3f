"""Blocks by bytes and combined spans against plain versions."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import spans


def plain_fragments(text, most):
    out = []
    for line in text.splitlines(keepends=True):
        part = ""
        for c in line:
            if part and len((part + c).encode()) > most:
                out.append(part)
                part = ""
            part += c
        out.append(part)
    return out


def plain_blocks(text, most):
    blocks = []
    for part in plain_fragments(text, most):
        if not blocks or len("".join([*blocks[-1], part]).encode()) > most:
            blocks.append([])
        blocks[-1].append(part)
    return blocks


def test_blocks_against_a_plain_version(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé😀 \n\r\x0b ") for _ in range(rng.randrange(120))) for _ in range(150)] + [None, "", "\n", "😀😀", "x" * 1_500]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, "a\nb")], "n long, t string").withColumns({"text": F.lit(1), "id": F.lit(2), "span": F.lit(3)})
    for most in (1, 3, 7, 40):
        rows = spans.byte_blocks(df, "n", "t", most).orderBy("n", "span").collect()
        got: dict = {}
        for r in rows:
            got.setdefault(r["n"], []).append((r["block"], r["text"]))
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["span_sha256"] and r["end_byte"] - r["start_byte"] == len(r["text"].encode())
        for i, text in enumerate(texts):
            want = [(k, part) for k, block in enumerate(plain_blocks(text or "", most), 1) for part in block]
            assert sorted(set(got.get(i, []))) == sorted(set(want)) and (i == 3 or len(got.get(i, [])) == len(want))
            if i != 3 and text:
                own = [r for r in rows if r["n"] == i]
                assert "".join(r["text"] for r in own) == text and [r["span"] for r in own] == list(range(1, len(own) + 1))
                assert all(a["end_byte"] == b["start_byte"] for a, b in zip(own, own[1:])) and own[0]["start_byte"] == 0
                for k in {r["block"] for r in own}:
                    whole = "".join(r["text"] for r in own if r["block"] == k)
                    assert {r["block_sha256"] for r in own if r["block"] == k} == {hashlib.sha256(whole.encode()).hexdigest()}
        assert len(got[None]) == (4 if most == 1 else 2) - (most == 1)


def test_hashes_are_checked(spark):
    df = spark.createDataFrame([(1, "a", hashlib.sha256(b"a").hexdigest()), (2, None, None)], "id int, t string, h string")
    assert spans.byte_blocks(df, "id", "t", 5, "h").count() == 1
    with pytest.raises(Exception, match="another hash"):
        spans.byte_blocks(df.withColumn("h", F.lit("x")), "id", "t", 5, "h").collect()
    with pytest.raises(ValueError):
        spans.byte_blocks(df, "id", "t", 0)
    assert spans.byte_blocks(df.limit(0), "id", "t").collect() == []


def plain_coalesced(rows, texts):
    out = []
    for chunk, span, a, b in sorted(set(rows), key=lambda r: (r[0], r[2], r[3], r[1])):
        if out and out[-1][0] == chunk:
            _, x, y, ids = out[-1]
            gap = texts[chunk][y:a]
            if (a <= y or len(gap) <= 32 and gap.isspace()) and max(b, y) - x <= 3200 and len({*ids, span}) <= 4:
                out[-1] = [chunk, x, max(b, y), ids if span in ids else [*ids, span]]
                continue
        out.append([chunk, a, b, [span]])
    return [(c, a, b, tuple(ids), texts[c][a:b]) for c, a, b, ids in out]


def test_combined_spans_against_a_plain_version(spark):
    rng = random.Random(4)
    texts = {f"c{k}": "".join(rng.choice("ab \n ") if rng.random() < 0.9 else " " * 40 for _ in range(300 if k else 9000)) for k in range(12)}
    rows = []
    for chunk, text in texts.items():
        for _ in range(40):
            a = rng.randrange(len(text) - 1)
            rows.append((chunk, f"s{rng.randrange(30)}", a, min(len(text), a + rng.randrange(1, 12 if chunk != "c0" else 2000))))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "chunk_id string, span_id string, start long, end long").withColumn("text", F.lit("x")).repartition(5)
    got = spans.coalesced(df, spark.createDataFrame(list(texts.items()), "chunk_id string, text string")).collect()
    assert sorted((r["chunk_id"], r["start_offset"], r["end_offset"], tuple(r["source_span_ids"]), r["text"]) for r in got) == sorted(plain_coalesced(rows, texts))
    assert all(r["text_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in got) and any(len(r["source_span_ids"]) == 4 for r in got)


def test_spans_of_unknown_chunks(spark):
    df = spark.createDataFrame([("c", "s", 0, 1)], "chunk_id string, span_id string, start long, end long")
    chunks = spark.createDataFrame([("d", "text")], "chunk_id string, text string")
    with pytest.raises(Exception, match="unknown chunk"):
        spans.coalesced(df, chunks).collect()
    assert spans.coalesced(df.limit(0), chunks).collect() == []


def test_what_goes_to_python_and_back_is_bounded(spark, monkeypatch):
    """Texts come in batches of few bytes, and one text's spans leave in several."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(spans, "OUT_BYTES", 1_000)
    spark.conf.unset(name)
    df = spark.createDataFrame([(1, "a line\n" * 40), (2, None), (3, "x")], "id long, t string").coalesce(1)
    got = spans.byte_blocks(df, "id", "t", 20).orderBy("id", "span").collect()
    assert spark.conf.get(name) == "4000000"
    assert "".join(r["text"] for r in got if r["id"] == 1) == "a line\n" * 40 and [r["span"] for r in got] == [*range(1, 41), 1]
    sizes = spark.createDataFrame([("y" * 1_000_000,)] * 20, "t string").coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert max(r["n"] for r in sizes.collect()) <= 5
