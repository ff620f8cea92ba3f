"""Periodic runs against brute force, whitening against a full decomposition, quality rules against labels; odd rows."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import periodic_runs, quality_rules, queries, whitening
from tests.llm.helpers import ODD, docs_frame, with_clashes, words


def brute_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if (length := i + q - s) >= max(least, times * q) and not any(w[s : s + length - r] == w[s + r : s + length] for r in range(1, q)):
                out.append((s, length, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        w = [b"%d" % rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(60))]
        if w and rng.random() < 0.5:
            p, a = rng.randrange(1, 8), rng.randrange(len(w))
            w = w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < len(w) else b"x" for i in range(a, len(w))]
        assert periodic_runs.find_runs(w) == brute_runs(w), w
        assert periodic_runs.find_runs(w, 3, 3) == brute_runs(w, 3, 3), w


def test_runs_of_long_periods_use_hashes():
    rng = random.Random(6)
    for period in (13, 40, 200):
        root = [b"%d" % rng.randrange(4) for _ in range(period)]
        w = [b"a", b"b"] + root * 5 + root[:7] + [b"end"] + root * 4
        assert periodic_runs.find_runs(w) == brute_runs(w)


def test_repeated_words_take_no_quadratic_time():
    thue_morse = [b"%d" % (bin(i).count("1") % 2) for i in range(2**15)]
    began = time.time()
    assert periodic_runs.find_runs([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic_runs.find_runs([b"a", b"b", b"c"] * 60_000) == [(0, 180_000, 3)]
    assert periodic_runs.find_runs(thue_morse) == []  # no cubes; and hashes modulo 2**64 would take parts of it for equal
    assert len(periodic_runs.find_runs([b"a"] * 50_000 + [b"b"] + [b"a"] * 50_000)) == 2
    assert time.time() - began < 30


def test_runs_query_rows(spark):
    rng = random.Random(7)
    texts = [*ODD, *[" ".join(words(rng, rng.randrange(1, 60), 3)) for _ in range(60)], "a b " * 5000, "x y z x y z x y z x y z x\ty z"]
    docs = with_clashes(docs_frame(spark, texts).unionByName(docs_frame(spark, ["q q q q q q q"]).withColumn("doc_id", F.lit(None).cast("long"))))
    planted = docs.select("doc_id", periodic_runs.repeat_some(F.col("doc_id"), F.col("text")).alias("text"), *docs.columns[2:])
    rows = {r["doc_id"]: r for r in periodic_runs.digest(periodic_runs.detect(planted)).collect()}
    assert len(rows) == len(texts) + 1 and rows[None]["n_runs"] == 1
    for i, text in enumerate(texts):
        w = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        r = rows[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best), text
        assert r["exponent_milli"] == (best[0] is not None and 1000 * best[1] // best[2] or None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


def test_no_runs_in_no_rows(spark):
    none = docs_frame(spark, ["a"]).limit(0)
    assert periodic_runs.digest(periodic_runs.detect(none)).count() == 0
    assert quality_rules.judged(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def whitened(spark, rows, k=8, block=None):
    df = with_clashes(spark.createDataFrame(rows, VECTORS)).repartition(3)
    model = whitening.fit(df, k, block=block)
    return model, whitening.by_component(whitening.whiten(df, model), model).collect()


@pytest.mark.parametrize("d, n, block", [(64, 300, 8), (12, 40, 10), (5, 200, 8), (20, 300, None)])
def test_whitening_against_full_decomposition(spark, d, n, block):
    rng = np.random.default_rng(d)
    v = (rng.standard_normal((n, d)) * rng.uniform(0.2, 3, d)).astype(np.float32)
    v[7] = v[8]
    bad = [(None, [0.5] * d), (9000, None), (9001, [None] * d), (9002, [float("nan")] + [0.0] * (d - 1)), (9003, [float("inf")] * d)]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(i, x, None) for i, x in bad]
    model, out = whitened(spark, rows, block=block)
    x = np.floor(1024 * np.vstack([v, np.full(d, 0.5)]).astype(float)) + 100_000
    total, c = x.sum(0), x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    assert model.n == len(x) and list(model.sums) == total.astype(int).tolist() and np.allclose(model.eigenvalues, values, rtol=1e-12)
    assert np.allclose(np.abs((model.components * vectors).sum(0)), 1, atol=1e-12)
    want = c @ vectors / np.sqrt(values) * np.sign((model.components * vectors).sum(0))
    assert len(out) == len(x) * len(values)
    for r in out:
        i = len(v) if r["vec_id"] is None else r["vec_id"]
        assert r["n"] == len(x) and r["deviation"] == sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(x[i], total))
        assert abs(r["whitened"] - want[i, r["component"] - 1]) < 1e-9 and r["identity_error"] < 1e-12
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(c.T @ c / len(x))) - 1) < 1e-12


def test_whitening_of_few_or_degenerate_rows(spark):
    assert whitened(spark, [])[1] == []
    assert whitened(spark, [(1, [1.0, 2.0], 0)] * 3)[1] == []  # no variance at all
    assert whitened(spark, [(1, [], 0), (2, [], 0)])[1] == []
    model, out = whitened(spark, [(1, [1.0, 2.0, 3.0], 0), (2, [2.0, 4.0, 6.0], 0), (3, [3.0, 6.0, 9.0], 0)])  # rank one
    assert {r["component"] for r in out} == {1} and len(out) == 3 and abs(out[0]["explained"] - 1) < 1e-12
    model, out = whitened(spark, [(1, [1.0], 0), (2, [1.0, 0.0], 0), (3, [3.0, 1.0], 0), (4, [], 0)])  # short ones end in zeros
    by = {(r["vec_id"], r["component"]): r for r in out}
    assert len(out) == 8 and by[1, 1]["whitened"] == by[2, 1]["whitened"] and by[1, 1]["deviation"] == by[2, 1]["deviation"]


def test_lanczos_restarts_where_the_space_ends():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for values in ([5.0] * 12 + [1.0] * 28, [9.0, 8.0, 7.0] + [0.0] * 37, list(range(40, 0, -1))):
        v = q @ np.diag(values) @ q.T
        for block in (1, 8, 11):
            got, vectors, passes = whitening.lanczos(lambda b: v @ b, 40, 8, block)
            assert np.allclose(got, values[:8], atol=1e-11), (values, block, got)
            assert passes <= 5
            assert np.allclose(v @ vectors, vectors * got, atol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)


def test_exact_deviations_of_large_numbers():
    x = np.array([[2**40, 5], [3, 2**41]])
    n, sums = 10**9, np.array([2**60, 2**61])
    assert whitening.deviations(x, n, sums) == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    assert np.allclose(whitening.centre(x, n, sums), x - sums / n)


def brute_counts(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)]


def test_rule_counts_against_brute_force():
    rng = random.Random(8)
    texts = [*ODD, "a b c d e a b c d e f a b c d e", "x\n\nx\n x\nx \r\n\x0b\n\x0b\n", "### | <a> $5 %&*", " a\u0085b c\x1cd"]
    texts += [" ".join(words(rng, 80, 2)) + "\n" + " ".join(words(rng, 30, 3)) for _ in range(60)]
    for text in texts:
        assert quality_rules.describe(text)[0] == brute_counts(text), text


def test_forest_finds_what_stands_apart():
    rng = np.random.default_rng(4)
    common, odd = rng.normal(0, 1, (2000, 4)), rng.normal(6, 0.3, (40, 4))
    forest = quality_rules.Forest(np.vstack([common, odd]), trees=100, sample=64)
    assert np.quantile(forest.scores(common), 0.98) < forest.scores(odd).min()
    assert quality_rules.Forest(np.ones((5, 2))).scores(np.ones((3, 2))).tolist() == [quality_rules.Forest(np.ones((5, 2))).scores(np.ones((1, 2)))[0]] * 3


def test_judged_rows(spark):
    rng = random.Random(9)
    good = [" ".join(words(rng, rng.randrange(30, 90), 3000)).replace("w1", "word, ") + "." for _ in range(260)]
    junk = [" ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in words(rng, rng.randrange(30, 90), 3000)) for _ in range(60)]
    texts = [*good, *junk, *ODD]
    docs = docs_frame(spark, texts)
    docs = with_clashes(docs.unionByName(docs.filter("doc_id in (0, 300)")).unionByName(docs_frame(spark, [good[0], None]).withColumn("doc_id", F.lit(None).cast("long")))).repartition(3)
    labelled = [(i, 1 if i < 260 else 0) for i in range(320) if i % 2] + [(5, 0), (None, 1), (7, None)]
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    rows = quality_rules.judged(docs, labels, most_lost=0.02).collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        if r["doc_id"] is not None:
            counts = brute_counts(texts[r["doc_id"]])
            assert [r[c] for c in quality_rules.BASE] == counts
            assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0]) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert len(kept & set(range(260))) >= 255 and len(kept & set(range(260, 320))) <= 1
    for some in ([], [(i, 1) for i in range(100)]):  # no bad row to calibrate with
        rows = quality_rules.judged(docs, spark.createDataFrame(some, "doc_id long, quality int")).collect()
        assert all(r["kept"] != r["base_failed"] for r in rows)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_embedding_whitening", "op13_quality_rules"])
def test_registered(name):
    assert name in queries.QUERIES
