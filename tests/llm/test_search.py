import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import decontam, license_scan, vptree
from tests.llm.helpers import ODD, docs_frame, with_clashes, words


def brute_edits(item, text):
    """Fewest edits between item and any run of words of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_edit_matcher():
    rng = random.Random(2)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        edits, a, b = decontam.EditMatcher(item).best(text)
        assert edits == brute_edits(item, text)
        run = text[a:b]
        whole = [list(range(len(run) + 1))]
        for i, w in enumerate(item, 1):
            whole.append([i])
            for j, v in enumerate(run, 1):
                whole[i].append(min(whole[i - 1][j - 1] + (w != v), whole[i - 1][j] + 1, whole[i][j - 1] + 1))
        assert whole[-1][-1] == edits


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, rng.randrange(12, 60), 3000))) for i in range(60)]
    texts, want = list(ODD), set()
    for d in range(300):
        w = words(rng, 120, 3000)
        if d % 2:
            i, t = items[rng.randrange(len(items))]
            own = t.split()
            for _ in range(rng.randrange(int(0.15 * len(own)) + 1)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["new"], ["new", own[at]]])
            w[40:40] = [x.upper() + "!" for x in own]
        texts.append(" ".join(w))
    short = [(200, "q1 q2"), (201, "q3"), (202, "q4 q5 q6 q7 q8 q9"), (203, "w1 q2")]
    for t in ("q1 q2", "q1 Q2!", "w7 q3", "q4 q5 q6 q8 q9", "q4 q5 w1 w2 q8 q9", "w2 q2"):
        texts.append(" ".join(words(rng, 30, 3000)) + f" {t} " + " ".join(words(rng, 30, 3000)))
    items += short
    benchmark = spark.createDataFrame([*items, (98, None), (99, ""), (100, "?!"), items[0]], "item_id long, text string")
    rows = decontam.find_contamination(with_clashes(docs_frame(spark, texts)), benchmark, max_block_words=1_500).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    for d, t in enumerate(texts):
        for i, s in items:
            own = decontam.words_of(s)
            if brute_edits(own, decontam.words_of(t)) <= int(0.2 * len(own) + 1e-9):
                want.add((d, i))
    assert got <= want and len(got) >= 0.97 * len(want) > 0
    assert {(d, i) for d, i in got if i in (200, 201, 203)} == {(d, i) for d, i in want if i in (200, 201, 203)}  # no edits: all of them
    assert {i for _, i in want} >= {200, 201, 202}
    for r in rows:
        run = decontam.words_of(texts[r["doc_id"]])[r["start_word"] : r["end_word"]]
        assert r["edits"] == brute_edits(decontam.words_of(dict(items)[r["item_id"]]), run)


def test_clean_leaves_the_rest(spark):
    rng = random.Random(4)
    item = " ".join(words(rng, 30, 3000))
    texts = ["x " + item + " y", " ".join(words(rng, 100, 3000)), None, ""]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.clean(docs_frame(spark, texts), benchmark).collect()) == [1, 2, 3]
    assert decontam.clean(docs_frame(spark, texts), benchmark.limit(0)).count() == 4
    assert decontam.find_contamination(docs_frame(spark, []), benchmark).count() == 0


def brute_nearest(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def vectors(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<float>")


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8)).astype(np.float32).astype(float)
    x[200:260] = x[7]  # many equal vectors
    ids = np.arange(1500)
    got = vptree.nearest(with_clashes(vectors(spark, ids, x)), F.col("vec_id") % 20 == 0, k=20, factor=1.0, shard_rows=400, block_rows=30).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(ids, x, 20)
    assert by.keys() == want.keys()
    for q in want:
        assert [v for v, _ in by[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in by[q]], [s for _, s in want[q]], atol=1e-12)


def test_recall_of_the_default_factor(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 32)) + 2 * rng.normal(size=(10, 32))[rng.integers(0, 10, 2000)]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    ids = np.arange(2000)
    got = vptree.nearest(vectors(spark, ids, x), F.col("vec_id") % 20 == 0, k=20, shard_rows=1000).collect()
    want = brute_nearest(ids, x, 20)
    hit = sum(r["vec_id"] in {v for v, _ in want[r["query_id"]]} for r in got)
    assert hit >= 0.9 * sum(map(len, want.values()))


def exact(spark, ids, x, **how):
    got = vptree.nearest(vectors(spark, ids, x), F.col("vec_id") % 20 == 0, k=20, factor=1.0, **how).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    return by


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(4)
    # 400 distinct vectors of one inner product with the first, and small integers, which tie everywhere
    flood = np.concatenate([np.ones((401, 1)), rng.normal(size=(401, 3)).astype(np.float32)], axis=1)
    flood[0] = [1, 0, 0, 0]
    small = rng.integers(-1, 2, (700, 4)).astype(float)
    small[(small == 0).all(axis=1)] = 1
    for x, how in ((flood, {"shard_rows": 10_000}), (flood, {"shard_rows": 60, "block_rows": 3}), (small, {"shard_rows": 90}), (small * 1e6, {"shard_rows": 90})):
        ids = rng.permutation(len(x)) if x is not flood else np.arange(len(x))
        assert exact(spark, ids, x, **how) == {q: [v for v, _ in rows] for q, rows in brute_nearest(ids, x, 20).items()}


def test_repeated_ids_and_large_norms(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)).astype(np.float32).astype(float) * 10.0 ** rng.integers(0, 7, (300, 1))
    x = x.astype(np.float32).astype(float)
    assert exact(spark, np.arange(300), x, shard_rows=50) == {q: [v for v, _ in rows] for q, rows in brute_nearest(np.arange(300), x, 20).items()}
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [3.0, 1.0]), (5, [2.0, 0.0]), (7, [1.0, 5.0])]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=3).collect()
    assert sorted(tuple(r) for r in got) == sorted([(20, 1, 20, 3.0), (20, 2, 5, 2.0), (20, 3, 7, 1.0), (20, 1, 7, 8.0), (20, 2, 5, 6.0), (20, 3, 20, 3.0)])


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.5, 0.5]), (20, [0.0, 2.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (60, [1.0, 1.0, 1.0, 1.0]), (61, [1.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vptree.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(0, 1, 7), (0, 2, 20), (20, 1, 7), (20, 2, 0), (60, 1, 61)}
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert vptree.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"]
    texts = [
        *ODD,
        "some prose\nReleased under the MIT License.\nmore prose",
        "RELEASED UNDER THE MIT LICENSE!!",
        "intro\n" + mit.replace("free of charge", "without any charge") + "\nend",
        "the license of poets is not given here, and no permission is asked",
        "a\nLicensed under the Apache License, Version 2.0.\nb\n" + "x\n" * 20 + "This work is licensed under the GNU General Public License, version 3.",
        "word " * 2000 + "Licensed under CC BY-NC 4.0. " + "word " * 2000,
    ]
    got = {}
    for r in license_scan.scan(with_clashes(docs_frame(spark, texts))).collect():
        got.setdefault(r["doc_id"] - len(ODD), []).append(r)
    assert [r["license"] for r in got[0]] == ["MIT statement"] == [r["license"] for r in got[1]]
    assert got[0][0]["n_missing"] == got[0][0]["n_added"] == 0 and got[0][0]["differences"] == ""
    assert [r["license"] for r in got[2]] == ["MIT"] and "-free of+without any" in got[2][0]["differences"]
    assert 3 not in got
    assert sorted(r["license"] for r in got[4]) == ["Apache-2.0 statement", "GPL-3.0 statement"]
    assert [r["license"] for r in got[5]] == ["CC-BY-NC-4.0 statement"]
    assert license_scan.scan(docs_frame(spark, [])).count() == 0


def test_short_license_statements_beside_full_texts(spark):
    t = license_scan.TEMPLATES
    pairs = [(full, short) for full in ("MIT", "Apache-2.0", "BSD", "GPL-3.0") for short in t if short.endswith("statement")]
    got = {i: set() for i in range(len(pairs))}
    for r in license_scan.scan(docs_frame(spark, [f"{t[full]}\n{t[short]}" for full, short in pairs])).collect():
        got[r["doc_id"]].add(r["license"])
    assert [p for i, p in enumerate(pairs) if not got[i] >= set(p)] == []


def test_licenses_in_long_lines(spark):
    prose, short = "word " * 400, license_scan.TEMPLATES["MIT statement"]
    texts = [
        prose + license_scan.TEMPLATES["Unlicense"] + " " + prose,
        # a near copy that lacks the template's rarest word, which stands elsewhere
        "word " * 40 + short.replace("Released", "Distributed") + " word" * 40 + "".join(f" {w}" + " word" * 20 for w in ("under", "the", "mit", "license", "released")),
        prose + short + " " + prose + short + " " + prose,
    ]
    rows = license_scan.scan(docs_frame(spark, texts)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in rows) == [(0, "Unlicense"), (1, "MIT statement"), (2, "MIT statement"), (2, "MIT statement")]


WRONG = [
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-ND 4.0.",
    "Released under the BSD License.",
    "This work is licensed under the GNU General Public License, version 2.",
    "Licensed under the Apache License, Version 1.1.",
    license_scan.TEMPLATES["GPL-2.0"].replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1").replace("This library is free software; you", "This is a library; you"),
    license_scan.TEMPLATES["GPL-2.0"].replace("GNU General", "GNU Affero General"),
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
]


def test_other_licenses_are_not_taken_for_similar_ones():
    matcher = license_scan.Matcher(license_scan.TEMPLATES, 0.8)
    for text in WRONG:
        assert [s[2] for s in matcher.statements(f"prose\n{text}\nmore")] in ([], ["LGPL"]), text
    assert [s[2] for s in matcher.statements(license_scan.TEMPLATES["LGPL"])] == ["LGPL"]


def test_statements_wrapped_over_lines():
    import textwrap

    matcher = license_scan.Matcher(license_scan.TEMPLATES, 0.8)
    for width in (24, 40, 70):
        for name, text in license_scan.TEMPLATES.items():
            lines = "before\n" + "\n".join("# " + x for x in textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False)) + "\nafter it"
            (a, b, got, _, _, missing, added), *more = matcher.statements(lines)
            assert (got, missing, added, more) == (name, 0, 0, []), (width, name)
            assert license_scan.words_of(lines[a:b]) == license_scan.words_of(text)


def test_very_many_statements_in_one_text():
    import time

    names = sorted(n for n in license_scan.TEMPLATES if n.endswith("statement"))
    began = time.time()
    found = license_scan.Matcher(license_scan.TEMPLATES, 0.8).statements("\n".join(license_scan.TEMPLATES[names[i % len(names)]] for i in range(30_000)))
    assert [f[2] for f in found] == [names[i % len(names)] for i in range(30_000)] and time.time() - began < 90


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_licenses(words_, templates, similarity=0.8):
    """Names of the templates that some run of words states: every template, every run."""
    found = set()
    for name, text in templates.items():
        t = license_scan.words_of(text)
        for s in range(len(words_)):
            for e in range(s + 1, min(len(words_), s + int(len(t) / similarity)) + 1):
                if lcs(words_[s:e], t) >= similarity * len(t):
                    found.add(name)
    return found


def test_every_statement_is_found():
    names = ("MIT statement", "CC-BY-4.0", "GPL-3.0 statement", "Apache-2.0 statement", "Unlicense", "CC-BY-4.0 statement", "CC-BY-NC-4.0 statement")
    text = "\n".join(license_scan.TEMPLATES[n] for n in names)
    assert [f[0] for f in sorted(license_scan.Matcher(license_scan.TEMPLATES, 0.8).find(text), key=lambda f: f[2])] == list(names)


def test_licenses_equal_brute_force():
    rng = random.Random(23)
    templates = {f"T{i}": " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 9))) for i in range(6)}
    matcher, stated = license_scan.Matcher(templates, 0.8), 0
    for _ in range(150):
        own = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(25))]
        for name in rng.sample(sorted(templates), rng.randrange(3)):
            t = templates[name].split()
            t[rng.randrange(len(t)) :][:1] = rng.choice([[], ["x"], ["x", "y"]])
            at = rng.randrange(len(own) + 1)
            own[at:at] = t
        found = matcher.find(" ".join(own))
        want = brute_licenses(own, templates)
        assert {f[0] for f in found} <= want
        # what is left out overlaps something that is reported
        for name in want - {f[0] for f in found}:
            t = templates[name].split()
            places = matcher.places(own, t)
            assert places and all(any(s < f[3] and f[2] < e for f in found) for s, e in places)
        stated += len(want)
        for name, _, s, e, diff, missing, added in found:
            t = templates[name].split()
            assert (missing == 0 and added == 0) == (own[s:e] == t) and len(t) - missing == e - s - added
    assert stated > 80


def test_decontamination_recall_at_the_edit_bound(spark):
    rng = random.Random(11)
    # all left out, all put in, all replaced, mixed
    kinds = [lambda w: [], lambda w: ["new", w], lambda w: ["new"], lambda w: rng.choice([[], ["new"], ["new", w]])]
    for length in (5, 7, 10, 20, 40, 60, 100, 200):
        items = [(i, " ".join(words(rng, length, 3000))) for i in range(40)]
        texts = []
        for d in range(200):
            own = [[w] for w in items[d % 40][1].split()]
            for at in rng.sample(range(length), length // 5):
                own[at] = kinds[d % 4](own[at][0])
            texts.append(" ".join(words(rng, 30 * (d % 3), 3000) + sum(own, []) + words(rng, 30 * (d % 2), 3000)))
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(docs_frame(spark, texts), benchmark).collect()}
        assert sum((d, d % 40) in got for d in range(200)) >= 0.96 * 200, length


def test_a_large_benchmark_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60_000, n))) for i, n in enumerate([40] * 4_000 + [1_000] * 40)]
    detector = decontam.Detector(items[:4], 0.8, 0.98, 4, 1, 7)
    counts = dict.fromkeys((int(np.log(n) / np.log(decontam.RATIO)) for n in (40, 1_000)), 40)
    tracemalloc.start()
    detector = decontam.Detector(items, 0.8, 0.98, 4, 1, 7, counts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    text = items[9][1].split() + ["x"] * 50 + items[4_005][1].split()
    assert {k for _, k, *_ in detector.find([text])} == {9, 4_005} and held < 200e6


def test_a_short_item_repeated_very_often():
    import time

    detector = decontam.Detector([(1, "alpha beta")], 0.8, 0.98, 4, 1, 7)
    began = time.time()
    found = detector.find([["alpha", "beta"] * 60_000])
    assert len(found) == 60_000 and all(e == 0 and y == x + 2 for _, _, x, y, e in found) and time.time() - began < 30
