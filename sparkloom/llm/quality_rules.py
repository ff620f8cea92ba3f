"""Quality rules: a few fixed ones, then an isolation forest over the statistics that rules look at.

Base rules: a text of fewer than ten words fails, and one of which more than a fifth of the words lies in repeated
five-word windows. The rest is judged by an isolation forest: each tree splits a sample of labelled documents at random
values of random statistics, and a document whose paths end early on average is an anomaly. The trees are fitted on at
most fit_rows labelled rows (those with the smallest hashes of doc_id and text), with few bad ones; the threshold is taken from the scores
of all labelled rows that pass the base rules: the one that tells good from bad best, within the share of good rows
that may be lost.

Null and empty texts have no words and fail the base rules. Rows are judged one by one: repeated rows, null ids and rows
of one doc_id with other texts give a row each (a label counts for each of its rows). Without labelled rows of both
kinds nothing but the base rules rejects. Labels that are null or repeat a doc_id are left out and counted once (the
worst one). Columns other than doc_id, text, quality are not read. Whole texts are read, one at a time.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, small_batches, text_blocks

WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules look at, as shares, so that long and short texts compare.
STATISTICS = ("mean_word", "symbols", "marks", "capitals", "digits", "duplicate_lines", "repeated_words", "commonest_word", "wordless", "distinct_letters")
STATS_SCHEMA = "doc_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, stats array<double>"


def _bytes(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


SYMBOL = _bytes(b"#*$%&|<>")
SPACE = _bytes(b" \t\n\v\f\r")
CAPITAL, SMALL, DIGIT = _bytes(bytes(range(65, 91))), _bytes(bytes(range(97, 123))), _bytes(b"0123456789")
MARK = _bytes(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
#: Bytes that begin no character in UTF-8.
INNER = _bytes(bytes(range(128, 192)))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows that are found twice or more."""
    grams = list(zip(*(words[k:] for k in range(window))))
    times = Counter(grams)
    if len(times) == len(grams):
        return 0
    covered, until = 0, 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered += i + window - max(i, until)
            until = i + window
    return covered


def describe(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts, and the statistics."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * len(STATISTICS)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(by_byte[~INNER & ~SPACE].sum())
    symbols = int(by_byte[SYMBOL].sum())
    lines = [line for line in text.split("\n") if line.encode().strip()]
    duplicates = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    letters = int(by_byte[CAPITAL].sum() + by_byte[SMALL].sum())
    wordless = sum(not w.isalnum() and not any(b >= 128 or chr(b).isalnum() for b in w) for w in words)
    shares = by_byte[SMALL] / max(1, by_byte[SMALL].sum())
    stats = [
        chars / n,
        symbols / chars,
        float(by_byte[MARK].sum()) / chars,
        float(by_byte[CAPITAL].sum()) / max(1, letters),
        float(by_byte[DIGIT].sum()) / chars,
        duplicates / len(lines),
        repeated / n,
        Counter(words).most_common(1)[0][1] / n,
        wordless / n,
        float(-(shares[shares > 0] * np.log(shares[shares > 0])).sum()),
    ]
    return [n, chars, symbols, duplicates, repeated], stats


def rule_statistics(docs: DataFrame) -> DataFrame:
    """The counts and statistics of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches, ("doc_id", "text_hash"), "text"):
            counts, stats = zip(*(describe(t) for t in texts))
            columns = [*zip(*ids), *zip(*counts)]
            arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(stats, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", *BASE, "stats"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, STATS_SCHEMA)


def base_failed(least_words: int = 10, most_repeated: int = 20):
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def mean_path(n: int) -> float:
    """The mean path of a search in a random binary tree of n leaves."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as arrays: of each node the statistic and value that split it (-1: a leaf), its children (the
    second follows the first), and for leaves the path that ends there."""

    def __init__(self, rows: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 13):
        rng = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        self.scale = mean_path(sample)
        deepest = max(1, math.ceil(math.log2(max(sample, 2))))
        self.trees = [self._grow(rows[rng.choice(len(rows), sample, replace=False)], deepest, rng) for _ in range(trees)]

    @staticmethod
    def _grow(rows: np.ndarray, deepest: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        split, value, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            spread = np.flatnonzero(high > low)
            if depth == deepest or not len(spread):
                path[node] = depth + mean_path(len(part))
                continue
            s = int(rng.choice(spread))
            split[node], value[node], child[node] = s, float(rng.uniform(low[s], high[s])), len(split)
            below = part[:, s] < value[node] if value[node] > low[s] else part[:, s] <= low[s]
            for side in (part[below], part[~below]):
                todo.append((len(split), side, depth + 1))
                split.append(-1), value.append(0.0), child.append(0), path.append(0.0)
        return np.array(split), np.array(value), np.array(child), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; the shorter the paths, the higher: 0.5 is the mean of random points."""
        total, at = np.zeros(len(rows)), np.arange(len(rows))
        for split, value, child, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            while len(inner := np.flatnonzero(split[node] >= 0)):
                n = node[inner]
                node[inner] = child[n] + (rows[at[inner], split[n]] >= value[n])
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / self.scale) if self.scale else np.zeros(len(rows))


def separation(values: np.ndarray, good: np.ndarray) -> float:
    """The chance that a bad row's value is above a good one's, ties half."""
    distinct, at = np.unique(values, return_inverse=True)
    of_good, of_bad = (np.bincount(at[side], minlength=len(distinct)) for side in (good, ~good))
    return float(((np.cumsum(of_good) - of_good / 2) * of_bad).sum() / of_good.sum() / of_bad.sum())


class Judge:
    """A forest over the statistics that tell the labels apart, and the score from which on a document is rejected."""

    def __init__(self, stats: np.ndarray, good: np.ndarray, least_separation: float = 0.1, trees: int = 200, sample: int = 64, most_bad: float = 0.05):
        self.threshold = math.inf
        both = bool(len(good)) and bool(good.any()) and not bool(good.all())
        self.used = [j for j in range(stats.shape[1]) if abs(separation(stats[:, j], good) - 0.5) > least_separation] if both else []
        rare = good | (np.cumsum(~good) <= max(1, most_bad * int(good.sum())))  # what is isolated has to be rare
        self.forest = Forest(stats[rare][:, self.used], trees, sample) if self.used else None

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return self.forest.scores(stats[:, self.used]) if self.forest else np.zeros(len(stats))

    def calibrate(self, counts: dict[tuple[int, bool], int], steps: int, most_lost: float) -> None:
        """The threshold from the number of rows at each score (in steps) and label: the most bad rows less good ones,
        as shares, with at most the share most_lost of the good ones; the highest of equals."""
        good, bad = (sum(v for (_, g), v in counts.items() if g == side) for side in (True, False))
        if not (self.forest and good and bad):
            return
        lost = caught = 0
        best = 0.0
        for step in sorted({s for s, _ in counts}, reverse=True):
            lost, caught = lost + counts.get((step, True), 0), caught + counts.get((step, False), 0)
            if lost <= most_lost * good and caught / bad - lost / good > best:
                best, self.threshold = caught / bad - lost / good, step / steps


def _scored(rows: DataFrame, judge: Judge) -> DataFrame:
    """rows with a column score; stats goes."""
    packed = pickle.dumps(judge)  # a few hundred trees of a bounded sample: some 300 kB
    names = [c for c in rows.columns if c != "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        for batch in batches:
            stats = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(model.scores(stats))], [*names, "score"])

    return rows.mapInArrow(run, ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in names] + ["score double"]))


def judged(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, most_lost: float = 0.005, steps: int = 10_000) -> DataFrame:
    """For each row of docs (doc_id, text): the base counts, base_failed, score (null where the base rules reject) and
    kept. labels: doc_id and quality (1 good, 0 bad). The statistics are written to the shared folder once; the
    threshold is that of all labelled rows, counted by score in steps."""
    stats = Scratch(rule_statistics(docs).withColumn("base_failed", base_failed())).read()
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    labelled = stats.filter("not base_failed").join(known, "doc_id").select("doc_id", "text_hash", "good", "stats")
    sample = labelled.withColumn("turn", F.xxhash64("doc_id", "text_hash")).orderBy("turn", "doc_id", "text_hash").limit(fit_rows).select("stats", "good").toArrow()
    good = sample.column("good").to_numpy(zero_copy_only=False).astype(bool)
    judge = Judge(np.array(sample.column("stats").to_pylist(), float).reshape(len(good), len(STATISTICS)), good)
    if judge.forest:
        by_score = _scored(labelled, judge).groupBy(F.floor(F.col("score") * steps).alias("step"), "good").count().collect()  # two rows for each step at most
        judge.calibrate({(r["step"], r["good"]): r["count"] for r in by_score}, steps, most_lost)
    scored = _scored(stats, judge).withColumn("score", F.when(~F.col("base_failed"), F.floor(F.col("score") * steps) / steps))
    rejected = F.col("base_failed") | (F.col("score") >= F.lit(float(judge.threshold)))
    return scored.withColumn("kept", ~rejected).select("doc_id", *BASE, "base_failed", "score", "kept")
