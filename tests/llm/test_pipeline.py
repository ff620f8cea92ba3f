"""The pipeline against a brute-force version of its stages, and every registered query on the smallest tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import queries
from tests.llm.helpers import ODD, docs_frame, words
from tests.llm.test_duplicates import brute_lines, brute_links
from tests.llm.test_search import brute_edits

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def letters(ws):
    return [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in ws]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    line = lambda n: " ".join(letters(words(rng, n, 2000)))
    items = [line(25) for _ in range(10)]
    shared = [line(8) for _ in range(12)]
    texts = list(ODD)
    for d in range(80):
        body = [line(12) for _ in range(rng.randrange(1, 8))]
        if d % 4 == 0:
            body[1:1] = shared[rng.randrange(4) :]
        if d % 5 == 0:
            body.append(items[rng.randrange(10)])
        texts.append("\n".join(body))
    texts += [texts[-1] + " extra", texts[-2], texts[20]]
    docs_frame(spark, texts, [None if i < len(ODD) else "en" for i in range(len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    got = defaultdict(int)
    for r in pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]

    known = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    cut = brute_lines([texts[i] for i in known])
    left = {known[k]: t for k, (_, gone, t) in cut.items() if not gone or t.strip()}
    ids = sorted(left)
    links = brute_links([left[i] for i in ids])
    one = [i for k, i in enumerate(ids) if links[k][1] == k]
    split = lambda t: re.findall(r"\w+", t.lower())
    clean = [i for i in one if all(brute_edits(split(b), split(left[i])) > 0.2 * len(split(b)) for b in items)]
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    assert dict(got) == {i: len(tokenizer.encode(left[i], add_special_tokens=False).ids) + 1 for i in clean}
    assert len(ids) > len(one) > len(clean) > 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_texts_of_one_doc_id_are_rows_of_their_own(spark, tmp_path):
    a, b, c = (" ".join(letters(words(random.Random(i), 40, 3000))) for i in (1, 2, 3))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (3, b + " more"), (4, c), (None, a), (5, None), (5, "")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars")
    left = pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left) == sorted([("1", a), ("2", b), ("4", c), ("None", a), ("5", ""), ("5", "")])
    spark.createDataFrame([(1, " ".join(b.split()[5:30])), (2, "one common word")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left) == sorted([("1", a), ("2", a), ("4", c), ("None", a), ("5", ""), ("5", "")])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_is_whole(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name.startswith(("op4_", "op7_", "op8_", "op3_")):
        assert rows.count() > 0
    elif name.startswith("op12_"):
        assert rows.count() == 8 * spark.read.parquet(f"{SF}/embeddings.parquet").count() == 8 * rows.select("vec_id").distinct().count()
    else:
        assert rows.count() == n == rows.select("doc_id").distinct().count()


def test_embedding_recall(spark):
    got = queries.op7_nearest_neighbours(spark, SF).collect()
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.array(v["embedding"].tolist(), float), v["vec_id"].to_numpy()
    hit = 0
    by = defaultdict(set)
    for r in got:
        by[r["query_id"]].add(r["vec_id"])
    for q, found in by.items():
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        hit += len(found & set(ids[np.lexsort((ids, -s))[:20]]))
    assert len(by) == (ids % 20 == 0).sum() and hit >= 0.9 * 20 * len(by)
