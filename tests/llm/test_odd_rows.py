"""Every operator on rows without an id, repeated rows, very long texts, ties, clashing names, and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontam, jaccard_join, lang_id, license_scan, line_dedup, packing, queries, secret_scan, substring_dedup, token_count
from tests.llm.helpers import ODD, docs_frame, with_clashes, words

PATH = queries.vocabulary()

OPERATORS = {
    "language_id": lambda d, b: lang_id.identify(d),
    "token_counts": lambda d, b: token_count.count_tokens(d, PATH),
    "packing": lambda d, b: packing.pack(d, PATH),
    "decontamination": lambda d, b: decontam.find_contamination(d, b),
    "secret_scan": lambda d, b: secret_scan.scan(d),
    "substring_dedup": lambda d, b: substring_dedup.remove_repeated(d),
    "license_scan": lambda d, b: license_scan.scan(d),
    "line_dedup": lambda d, b: line_dedup.dedup_lines(d),
    "jaccard_join": lambda d, b: jaccard_join.jaccard_components(d),
}
#: Operators that return a row for each row.
ROW_BY_ROW = ("language_id", "token_counts", "secret_scan", "substring_dedup", "line_dedup", "jaccard_join")


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(31)
    item = " ".join(words(rng, 20, 3000))
    long = "\n".join(" ".join(words(rng, 12, 100_000)) for _ in range(20_000)) + f"\n{item} Released under the MIT License. token=abcdefgh12"
    texts = [*ODD, *ODD, long, long, "short text", " ".join([item, item])]
    d = docs_frame(spark, texts)
    d = d.unionByName(d.filter("doc_id in (0, 4, 11, 24)").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(d.filter("doc_id in (4, 24, 26)"))
    d = d.unionByName(docs_frame(spark, ["another text of the same id"]).withColumn("doc_id", F.lit(4).cast("long")))
    d = d.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "de"))
    return with_clashes(d).repartition(3).cache(), spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string"), len(texts) + 4 + 3 + 1, long


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(tables, name):
    docs, benchmark, n, long = tables
    rows = OPERATORS[name](docs, benchmark).collect()
    if name in ROW_BY_ROW:
        assert len(rows) == n and sum(r["doc_id"] is None for r in rows) == 4
    of_long = [r for r in rows if r["doc_id"] == 24]
    assert len(of_long) >= (2 if name != "license_scan" else 1)
    if name == "line_dedup":
        assert sorted(len(r["text"]) for r in of_long)[-1] == len(long) and sum(r["n_removed"] > 20_000 for r in rows) == 2
    if name == "substring_dedup":
        assert all(r["n_words"] - r["n_removed"] < 35 for r in of_long)
    if name == "jaccard_join":
        assert {r["component_id"] for r in rows if r["doc_id"] in (24, 25)} == {24}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, tables, name):
    docs, benchmark, *_ = tables
    assert OPERATORS[name](docs.limit(0), benchmark.limit(0)).count() == 0


def test_pipeline_of_odd_rows_and_of_none(spark, tables, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, benchmark, *_ = tables
    for k, d in enumerate((docs, docs.limit(0))):
        d.write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        benchmark.write.parquet(str(tmp_path / str(k) / "benchmark.parquet"))
        rows = pipeline.run(spark, str(tmp_path / str(k))).collect()
        assert bool(rows) == (k == 0)
