"""The order of shingles in the Jaccard join comes from all documents."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import jaccard_join
from tests.llm.helpers import ODD, docs_frame, words
from tests.llm.test_duplicates import near_copies


def brute_counts(texts):
    counts = np.zeros(jaccard_join.BUCKETS, np.int64)
    shingler = jaccard_join.Shingler(5)
    for t in texts:
        for h in set(shingler.sets([t])[1].tolist()):
            counts[h * jaccard_join.BUCKETS >> 64] += 1
    return np.maximum(counts - int(counts.mean()), 0)


def test_counts_of_buckets(spark):
    rng = random.Random(21)
    texts = [*ODD, *near_copies(rng, 4, 10), "one two three four five six", " ".join(["again"] * 50)]
    assert (jaccard_join.shingle_counts(docs_frame(spark, texts).repartition(7), 5) == brute_counts(texts)).all()
    assert not jaccard_join.shingle_counts(docs_frame(spark, []), 5).any()


def test_every_document_is_counted(spark):
    """More documents than a sample once had: each counts, in whatever task, and the list of what all hold is dealt."""
    n = 12_000
    docs = spark.range(n, numPartitions=5).select(F.col("id").alias("doc_id"), F.concat(F.lit("five words that all hold w"), F.col("id").cast("string")).alias("text"))
    counts = jaccard_join.shingle_counts(docs, 5)
    common = jaccard_join.bucket_of(jaccard_join.Shingler(5).sets(["five words that all hold"])[1])[0]
    assert n <= counts[common] < n + 20
    assert counts.sum() == 2 * n
    lists = jaccard_join.short_lists(docs, 5, 40, counts, 4_000).filter(F.col("kind") == jaccard_join.SHORT)
    dealt = {r["n"]: r["count"] for r in lists.groupBy("x", "n").count().filter("count > 100").collect()}
    assert sorted(dealt) == [0, 1, 2] and sum(dealt.values()) == n


def test_any_counts_give_the_same_components(spark, monkeypatch):
    rng = random.Random(22)
    passage = " ".join(words(rng, 40))
    texts = [*ODD, *near_copies(rng, 5, 8), *[passage + " " + " ".join(words(rng, 30)) for _ in range(20)]]
    d = docs_frame(spark, texts)
    want = sorted(map(tuple, jaccard_join.jaccard_components(d, list_rows=3).collect()))
    some = np.random.default_rng(1).integers(0, 30, jaccard_join.BUCKETS).astype(np.int32)
    monkeypatch.setattr(jaccard_join, "shingle_counts", lambda docs, k: some)
    assert sorted(map(tuple, jaccard_join.jaccard_components(d, list_rows=3).collect())) == want


def test_sets_are_sorted():
    texts = [" ".join(words(random.Random(i), 30, 12)) for i in range(40)] + ODD + ["a b c d e f"] * 70_000
    text, h = jaccard_join.Shingler(5).sets(texts)
    order = np.lexsort((h, text))
    assert (order == np.arange(len(h))).all() and len(h) == len(set(zip(text.tolist(), h.tolist())))
    few = jaccard_join.Shingler(5).sets(texts[:60])
    assert all((a == b[: len(a)]).all() for a, b in zip(few, (text, h)))
