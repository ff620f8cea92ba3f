"""Language identification by words first, backing off to ever shorter character n-grams.

Model: for each language the log frequency of words, and for words it doesn't know those of character n-grams of four,
three, two letters and one. A known word counts with its log frequency in every language (a floor where a language
lacks it). An unknown word is cut from left to right into the longest known n-grams and counts with their mean. The
mean over all words, scaled, gives a share for each language; the largest wins, ties to the name that comes first.

fit learns from a sample of about docs_per_language labelled documents of each language (all of them where there are
fewer), chosen by a hash of doc_id, and keeps every word and n-gram of the sample, so that bound alone bounds the model.
Rows without text or language teach nothing. predict reads whole texts, very long ones one at a time: null or letterless
texts get `und`, 0.0; repeated rows and rows without a doc_id get results like others (held_out is null without one);
languages of equal share go to the name that comes first; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches, text_blocks
from sparkloom.llm.token_count import Kept

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
WORD = re.compile(r"[^\W\d_]+")
GRAMS = (4, 3, 2, 1)


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray

    def pieces(self, word: str) -> list[int]:
        """Rows of the table that a word is scored by: its own, or those of its n-grams."""
        if (known := self.words.get(word)) is not None:
            return [known]
        found, at, marked = [], 0, f" {word} "
        while at < len(marked):
            for n in GRAMS:
                if (g := self.grams.get(marked[at : at + n])) is not None:
                    found.append(g)
                    at += n
                    break
            else:
                found.append(0)
                at += 1
        return found


class WordScores:
    """Log frequencies of words in each language, remembered for the first max_words."""

    def __init__(self, model: LanguageModel, max_words: int = 150_000):
        self.model, self.max_words = model, max_words
        self.row = Kept()
        self.kept = np.zeros((0, len(model.languages)))
        self.table = self.kept

    def learn(self, words: set[str]) -> None:
        """Afterwards, row and table have what is needed for these words."""
        new = [w for w in words if w not in self.row]
        pieces = [self.model.pieces(w) for w in new]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if new:
            flat = self.model.table[np.fromiter(chain.from_iterable(pieces), np.int64, int(sizes.sum()))]
            fresh = np.add.reduceat(flat, np.r_[0, np.cumsum(sizes)[:-1]]) / sizes[:, None]
        else:
            fresh = self.kept[:0]
        known = len(self.kept)
        self.table = np.concatenate([self.kept, fresh])
        if known + len(new) <= self.max_words:
            self.row.update(zip(new, range(known, known + len(new))))
            self.kept = self.table
        else:
            self.row.block = dict(zip(new, range(known, known + len(new))))


def fit(labelled: DataFrame, docs_per_language: int = 1_000) -> LanguageModel:
    """Learns from rows (doc_id, text, lang)."""
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], {}, {}, np.zeros((1, 0)))
    bound = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1_000_000, math.ceil(1e6 * docs_per_language / n)))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < bound[F.col("lang")])
    words = sample.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    found = words.toArrow()
    for lang, w, n in zip(*(found.column(c).to_pylist() for c in ("lang", "w", "n"))):
        counts[lang][w] = n
    return build(counts)


def build(counts: dict[str, dict[str, int]]) -> LanguageModel:
    langs = sorted(counts)
    grams: dict[str, Counter] = {}
    for lang in langs:
        c: Counter = Counter()
        for w, k in counts[lang].items():
            marked = f" {w} "
            for n in GRAMS:
                for i in range(len(marked) - n + 1):
                    c[marked[i : i + n]] += k
        grams[lang] = c

    rows = [np.full(len(langs), math.log(1e-7))]

    def add(own: dict[str, dict[str, int]]) -> dict[str, int]:
        total = np.array([sum(own[x].values()) for x in langs], float)
        kept = sorted(set().union(*own.values()))
        first = sum(map(len, rows)) // len(langs)
        rows.append(np.log((np.array([[own[x].get(k, 0) for x in langs] for k in kept], float).reshape(-1, len(langs)) + 0.05) / (total + 1)).ravel())
        return dict(zip(kept, range(first, first + len(kept))))

    words, grams_at = add(counts), add(grams)
    return LanguageModel(langs, words, grams_at, np.concatenate(rows).reshape(-1, len(langs)))


class Predictor:
    """Languages and scores of texts."""

    def __init__(self, model: LanguageModel, sharpness: float):
        self.model, self.sharpness, self.memo = model, sharpness, WordScores(model)

    def of(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        # digits such as superscripts pass for letters in the pattern, so a text must also hold a letter
        split = [WORD.findall(t.lower()) if t and self.model.languages and any(map(str.isalpha, t)) else [] for t in texts]
        self.memo.learn(set().union(*split))
        preds, scores = [], []
        for words in split:
            if not words:
                preds.append("und")
                scores.append(0.0)
                continue
            mean = self.memo.table[np.fromiter(map(self.memo.row.__getitem__, words), np.int64, len(words))].mean(axis=0)
            share = np.exp(self.sharpness * (mean - mean.max()))
            best = int(np.argmax(share))
            preds.append(self.model.languages[best])
            scores.append(float(share[best] / share.sum()))
        return preds, scores


def predict(docs: DataFrame, model: LanguageModel, sharpness: float = 8.0) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value, sharpness)
        for batch in batches:
            at = 0
            for ids, texts in text_blocks([batch], "doc_id", "text"):
                preds, scores = predictor.of(texts)
                held = batch.column("held_out").slice(at, len(ids))
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), held, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float, sharpness: float = 8.0) -> DataFrame:
    """The rows of docs, all their columns, whose text has a language with a score of min_score at least. No shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value, sharpness)
        for batch in batches:
            at = 0
            for ids, texts in text_blocks([batch], "doc_id", "text"):
                preds, scores = predictor.of(texts)
                keep = pa.array([p != "und" and s >= min_score for p, s in zip(preds, scores)], pa.bool_())
                yield batch.slice(at, len(ids)).filter(keep)
                at += len(ids)

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """Documents that no model may learn from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Fits on the labelled documents that aren't held out and predicts all."""
    return predict(docs, fit(docs.filter(~held_out()), **bounds))
