import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import components, jaccard_join, line_dedup, substring_dedup
from tests.llm.helpers import ODD, docs_frame, with_clashes, words


def brute_links(texts, percent=80):
    sets = []
    for t in texts:
        w = t.encode().lower().split() if t else []
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_copies(rng, n_bases, copies, length=120):
    texts = []
    for _ in range(n_bases):
        base = words(rng, length)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(length)] = "edit%d" % rng.randrange(1000)
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("max_group, list_rows", [(10_000_000, 4_000), (300, 3), (10_000_000, 6)])
def test_jaccard_components(spark, max_group, list_rows):
    rng = random.Random(3)
    passage = " ".join(words(rng, 40))
    texts = [*ODD, *near_copies(rng, 8, 12), *[passage + " " + " ".join(words(rng, 60)) for _ in range(40)], *[" ".join(words(rng, n)) for n in (1, 3, 4, 5, 6)] * 2]
    texts += [texts[20]] * 30 + ["A b C d E f", "a B c D e F"]
    rows = jaccard_join.jaccard_components(with_clashes(docs_frame(spark, texts)), sample_docs=40, max_group_shingles=max_group, list_rows=list_rows).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_links(texts)


def test_t_occurrence_search_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(0, 1000, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.3, rng.integers(0, 1000, 60).astype(np.uint64), base)) for _ in range(25)]
        label = jaccard_join.search(sets, 80)
        link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        for i in range(25):
            for j in range(i):
                if link(sets[i], sets[j]):
                    assert label[i] == label[j]
        want, seen = [], {}
        for i in range(25):
            group = {i}
            while True:
                more = {j for j in range(25) for k in group if link(sets[j], sets[k])} | group
                if more == group:
                    break
                group = more
            want.append(min(group))
        assert label == want


def test_long_chain_of_edges(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4))
    rows = {r["node"]: r["component"] for r in found.collect()}
    assert len(rows) == 203 and set(rows.values()) == {0, 1000} and rows[200] == 0


def brute_windows(texts, length):
    docs = [t.encode().split() if t else [] for t in texts]
    at = defaultdict(list)
    for d, w in enumerate(docs):
        for i in range(len(w) - length + 1):
            at[tuple(w[i : i + length])].append((d, i))
    gone = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    return {d: (len(w), len(gone[d]), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone[d])).hexdigest()) for d, w in enumerate(docs)}


@pytest.mark.parametrize("least", [3, 10**9])
def test_substring_dedup(spark, least):
    rng = random.Random(4)
    passage, tail = words(rng, 60), words(rng, 50)
    texts = [*ODD, *near_copies(rng, 6, 6)]
    texts += [" ".join(words(rng, rng.randrange(50)) + passage[rng.randrange(20) :] + words(rng, 40)) for _ in range(25)]
    texts += [" ".join(tail + tail + words(rng, 10) + tail[:35]), "a " * 200, "é b\tc " * 30, texts[15], " ".join(passage[:34])]
    rows = substring_dedup.remove_repeated(with_clashes(docs_frame(spark, texts)), length=35, least=least).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute_windows(texts, 35)


def test_substrings_of_repeated_rows_and_ids(spark):
    rng = random.Random(17)
    one, two, three = (" ".join(words(rng, 60, 5000)) for _ in range(3))
    null = F.lit(None).cast("long")
    texts = [one, one, two, three, "a b", two + " x", one]
    d = docs_frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 3, 7).when(F.col("doc_id") < 6, F.col("doc_id")).otherwise(null))
    got = sorted(tuple(r) for r in substring_dedup.remove_repeated(d).fillna(-1, ["doc_id"]).collect())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(7, 60, 60, digest("")), (7, 60, 60, digest("")), (7, 60, 60, digest("")), (3, 60, 0, digest(three)), (4, 2, 0, digest("a b")), (5, 61, 60, digest("x")), (-1, 60, 0, digest(one))])


def test_suffix_automaton_counts():
    rng = random.Random(6)
    for _ in range(50):
        seqs = {tuple(rng.choice(b"ab") for _ in range(rng.randrange(1, 14))): rng.randrange(1, 3) for _ in range(4)}
        automaton = substring_dedup.SuffixAutomaton()
        for s, n in seqs.items():
            automaton.add(list(s), n)
        automaton.close()
        total = Counter()
        for s, n in seqs.items():
            for i in range(len(s) - 2):
                total[s[i : i + 3]] += n
        for s in seqs:
            assert list(automaton.repeated(list(s), 3)) == [i for i in range(len(s) - 2) if total[s[i : i + 3]] > 1]


def brute_ends(lines):
    """Last lines, counted from 1, of chunks: where the hash of two lines is least among its neighbours."""
    h = [int(hashlib.md5(line.encode()).hexdigest()[:7], 16) for line in lines]
    n, r = len(lines), {i: (h[i - 2] * 31 + h[i - 1]) * 40503 % 2**32 for i in range(2, len(lines) + 1)}
    return [i for i in range(1, n + 1) if i == n or 2 <= i <= n - 2 and r[i] <= r[i + 1] and (i == 2 or r[i] < r[i - 1])]


def brute_lines(texts):
    seen, out = set(), {}
    for d, t in enumerate(texts):
        if t is None:
            out[d] = (0, 0, None)
            continue
        lines = t.split("\n")
        ends = brute_ends(lines)
        kept, gone = [], 0
        for c in (lines[a:b] for a, b in zip([0, *ends], ends)):
            if len(c) > 1 and tuple(c) in seen:
                gone += len(c)
            else:
                kept.append("\n".join(c))
            if len(c) > 1:
                seen.add(tuple(c))
        out[d] = (len(lines), gone, "\n".join(kept))
    return out


def line_texts(rng):
    lines = [" ".join(words(rng, 6)) for _ in range(80)]
    texts = [*ODD]
    for _ in range(60):
        i = rng.randrange(60)
        texts.append("\n".join([" ".join(words(rng, 5)) for _ in range(rng.randrange(3))] + lines[i : i + rng.randrange(1, 15)] + [" ".join(words(rng, 5))]))
    return [*texts, texts[-1], "a\nb\n" * 30, "\n".join(lines), "\n".join(lines)]


def test_line_dedup(spark):
    texts = line_texts(random.Random(8))
    d = with_clashes(docs_frame(spark, texts)).withColumns({c: F.lit("x") for c in ("n_lines", "n_removed")})
    got = line_dedup.dedup_lines(d)
    assert got.columns == [c for c in d.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    rows = got.collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in rows} == brute_lines(texts)
    assert {r["lines"] for r in rows} == {"x"}


def test_exact_copies_go_whole(spark):
    rng = random.Random(15)
    texts = [" \n".join(" ".join(words(rng, 4, 5000)) for _ in range(n)) for n in range(2, 40)]
    rows = line_dedup.dedup_lines(docs_frame(spark, texts * 2)).filter(F.col("doc_id") >= len(texts)).collect()
    assert len(rows) == len(texts) and all(r["text"] == "" and r["n_removed"] == r["n_lines"] for r in rows)


def test_lines_of_repeated_rows_and_ids(spark):
    rng = random.Random(16)
    one, two = ("\n".join(" ".join(words(rng, 4, 5000)) for _ in range(9)) for _ in range(2))
    null = F.lit(None).cast("long")
    d = docs_frame(spark, [one, one, two, "a\nb"]).withColumn("doc_id", F.when(F.col("doc_id") < 3, 7).otherwise(null))
    d = d.unionByName(docs_frame(spark, [two]).withColumn("doc_id", F.lit(9).cast("long"))).unionByName(d.filter("doc_id is null"))
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(d).collect())
    assert got == sorted([(7, 0, one), (7, 9, ""), (7, 0, two), (9, 9, ""), (0, 0, "a\nb"), (0, 0, "a\nb")])


def test_line_dedup_is_native(spark):
    plan = line_dedup.dedup_lines(docs_frame(spark, ["a\nb"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_tables(spark):
    empty = docs_frame(spark, [])
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert substring_dedup.remove_repeated(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_jaccard_rows_without_doc_id(spark):
    import corpus_pipeline

    texts = near_copies(random.Random(12), 3, 4) + [None, "", "one two three four five six"]
    d = docs_frame(spark, texts)
    same, null = d.filter("doc_id in (0, 13, 14)"), F.lit(None).cast("long")
    d = d.unionByName(same.withColumn("doc_id", null))
    links = brute_links(texts)
    rows = [tuple(r) for r in jaccard_join.jaccard_components(d).select("doc_id", "n_shingles", "component_id").collect()]
    assert {i: (n, c) for i, n, c in rows if i is not None} == links
    assert sorted(n for i, n, c in rows if i is None and c is None) == sorted(links[i][0] for i in (0, 13, 14))
    kept = corpus_pipeline.one_of_each_group(spark, d, "").collect()
    assert {r["doc_id"] for r in kept} == {i for i, (_, c) in links.items() if i == c} | {None}
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == sorted(texts[i] for i in (0, 13, 14))
