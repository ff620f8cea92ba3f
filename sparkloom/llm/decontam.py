"""Finds passages of a benchmark in documents by a CGK embedding, bit sampling and exact edit distances.

The unit is the lower-case word. The CGK embedding of a word sequence is a walk: at each of its steps it writes the
word it stands on and, by a random bit of step and word, stays or moves on; sequences a few edits apart give walks
that differ in a few steps, so edit distance becomes Hamming distance. Each repetition has its own random bits and
samples a few steps of a short stretch that begins at a random word of the items, as edits part walks that are long;
an item and a window that write the same words there are candidates. For each class of lengths repetitions are added
until they find the recall asked for of copies of its items with as many edits as the similarity allows (if not even
MOST do, a warning says so). Then edit distances decide exactly: a passage is contaminated if some window is within
(1 - similarity) * (words of the item) word edits of the item.

Windows begin at every word of a document and have the size of the items, in classes of lengths within a ratio of
1.5. A window that holds too few words of the benchmark at all cannot be near any item and is left out first, by
sums; sampled steps are read in order and windows that agree with no item drop out at once.

The benchmark is broadcast in blocks of at most max_block_words words, or one longer item; where there are several,
each has a pass of its own whose findings are written before the next begins, so one block is held at a time. Random bits
come from hashes of words, so what a task holds is a few numbers for each item and repetition.

Items of any length are searched: of those of fewer than 1 / (1 - similarity) words, which allow no edit, exact copies
are found. Null, empty and wordless items are none, and null and empty texts hold nothing. Of several occurrences of an
item that do not overlap each is reported; of overlapping ones that with the fewest edits, then the leftmost. Repeated
rows and rows without a doc_id are searched like others, very long texts one at a time. Other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
import warnings
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import KEY, Scratch, mix, small_batches, text_blocks, with_text_keys

SCHEMA = "doc_id long, item_id long, start_word int, end_word int, edits int, item_words int"
WORD = re.compile(r"\w+")
RATIO = 1.5
#: Steps of a walk that samples are taken of; few, as edits part walks.
STRETCH = 16
#: Edited copies of items that repetitions are tried on, and the most repetitions.
TRIALS, MOST = 400, 400


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class EditMatcher:
    """Fewest edits between a word sequence and any run of words of another (bit-parallel)."""

    def __init__(self, item: list):
        self.item = item
        self.forward, self.backward = self._masks(item), self._masks(item[::-1])

    @staticmethod
    def _masks(words: list) -> dict:
        masks: dict = defaultdict(int)
        for i, w in enumerate(words):
            masks[w] |= 1 << i
        return dict(masks)

    def _ends(self, masks: dict, words: list, anchored: bool) -> Iterator[int]:
        """Edits of the best run that ends after each word; anchored: that begins at the first."""
        m = len(self.item)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        for w in words:
            eq = masks.get(w, 0)
            x = eq | minus
            d = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | ~(d | plus) & full, plus & d
            score += 1 if up & top else -1 if down & top else 0
            up, down = ((up << 1) | anchored) & full, (down << 1) & full
            plus, minus = down | ~(x | up) & full, up & x
            yield score

    def best(self, words: list) -> tuple[int, int, int]:
        """(edits, first word, end) of the best run; of equal ones the one that ends first, then the shortest."""
        least, end = min(((s, i + 1) for i, s in enumerate(self._ends(self.forward, words, False))), default=(len(self.item), 0))
        for back, s in enumerate(self._ends(self.backward, words[:end][::-1], True)):
            if s == least:
                return least, end - back - 1, end
        return least, end, end


class Repetition:
    """Random bits, sampled steps and the first word of one embedding, and the items' samples."""

    def __init__(self, items: list[np.ndarray], which: list[int], vocabulary: int, least: int, samples: int, rng: np.random.Generator):
        self.offset = int(rng.integers(0, max(1, least - STRETCH // 2)))
        steps = max(1, min(STRETCH, int(RATIO * (least - self.offset))))
        self.at = np.sort(rng.choice(steps, min(samples, steps), replace=False))
        self.seed, self.vocabulary = np.uint64(rng.integers(0, 2**63)), vocabulary
        moves = self.moves()
        which = np.array(which)
        lengths = np.fromiter((len(items[k]) for k in which), np.int64, len(which))
        flat, base = np.concatenate([items[k] for k in which]), np.cumsum(lengths) - lengths
        i, key, written = np.full(len(which), self.offset), np.zeros(len(which), np.uint64), []
        for step in range(int(self.at[-1]) + 1):
            going = i < lengths
            i, key, which, lengths, base = i[going], key[going], which[going], lengths[going], base[going]
            written = [w[going] for w in written]
            words = flat[base + i]
            if step in self.at:
                key = self.extend(key, words)
                written.append(key)
            i = i + (moves[words] >> np.uint16(step) & np.uint16(1))
        # a walk that left its item before its last sample is gone
        self.sorted = [np.unique(w) for w in written]
        order = np.argsort(key, kind="stable")
        self.keys, self.items = key[order], which[order]

    def moves(self) -> np.ndarray:
        """For each word a bit for each step, by a hash."""
        return (mix(np.arange(self.vocabulary + 1, dtype=np.uint64) ^ self.seed) >> np.uint64(20)).astype(np.uint16)

    @staticmethod
    def extend(key, word):
        with np.errstate(over="ignore"):
            return mix(key * np.uint64(0x9E3779B97F4A7C15) + np.asarray(word).astype(np.uint64) + np.uint64(1))

    def candidates(self, words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words of the walks, items) of the walks that agree with an item's; words is padded."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.keys):
            return none
        moves = self.moves()
        i, key, sampled = start.copy(), np.zeros(len(start), np.uint64), 0
        for step in range(int(self.at[-1]) + 1):
            own = words[i]
            if step == self.at[sampled]:
                key, known = self.extend(key, own), self.sorted[sampled]
                alive = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                start, i, key, own = start[alive], i[alive], key[alive], own[alive]
                sampled += 1
                if not len(start):
                    return none
            i = i + (moves[own] >> np.uint16(step) & np.uint16(1))
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = high - low
        at = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(start, n), self.items[at]


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The item with so many words replaced, left out or put in; 0 is a word of no item."""
    own, places = [[w] for w in item.tolist()], rng.choice(len(item), edits, replace=False)
    for at, kind in zip(places.tolist(), rng.integers(0, 3, edits).tolist()):
        own[at] = [[0], [], [own[at][0], 0]][kind]
    return np.array([w for ws in own for w in ws], np.int64)


class Detector:
    """With counts (repetitions of each class of lengths) as given, or else as many as reach the recall on edited copies."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float, samples: int, min_words: int, seed: int, counts: dict[int, int] | None = None):
        split = [(i, w) for i, t in items if len(w := words_of(t)) >= min_words]
        self.ids = [i for i, _ in split]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.items = [np.array([self.number[w] for w in ws], np.int64) for _, ws in split]
        self.edits = [math.floor((1 - similarity) * len(x) + 1e-9) for x in self.items]
        self.matchers = [EditMatcher(x.tolist()) for x in self.items]
        self.longest = max(map(len, self.items), default=0)
        classes: dict[int, list[int]] = defaultdict(list)
        for k, x in enumerate(self.items):
            classes[int(math.log(len(x)) / math.log(RATIO))].append(k)
        self.classes, self.counts = [], {}
        for c, which in classes.items():
            least, edits = min(len(self.items[k]) for k in which), max(self.edits[k] for k in which)

            def repetition(r: int, c=c, which=which, least=least) -> Repetition:
                return Repetition(self.items, which, len(self.number), least, samples, np.random.default_rng([seed, c, r]))

            n = counts[c] if counts else self.enough(which, repetition, recall, np.random.default_rng([seed, c]))
            self.counts[c] = n
            self.classes.append((least, least - edits, [repetition(r) for r in range(n)]))

    def enough(self, which: list[int], repetition, recall: float, rng: np.random.Generator) -> int:
        """Repetitions that miss at most half of what the recall allows, of items with as many edits as the similarity does."""
        item = rng.permutation(np.resize(np.array(which), TRIALS))
        copies = [edited(self.items[k], self.edits[k], rng) for k in item]
        gap = np.zeros(2 * self.longest + 2, np.int64)
        text = np.concatenate([x for c in copies for x in (c, gap)])
        ends = np.cumsum([len(c) + len(gap) for c in copies])
        start = np.flatnonzero(text)
        missed = np.ones(len(item), bool)
        for r in range(MOST):
            s, k = repetition(r).candidates(text, start)
            t = np.searchsorted(ends, s, "right")
            missed[t[item[t] == k]] = False
            if missed.mean() <= (1 - recall) / 2:
                return r + 1
            start = start[missed[np.searchsorted(ends, start, "right")]]
        warnings.warn(f"{MOST} repetitions find {1 - missed.mean():.3f} of edited copies of {len(which)} items, {recall} was asked for")
        return MOST

    def find(self, docs: list[list[str]]) -> list[tuple[int, int, int, int, int]]:
        """(document index, item, first word, end, edits)."""
        n = np.fromiter(map(len, docs), np.int64, len(docs))
        get = self.number.get
        words = np.fromiter((get(w, 0) for ws in docs for w in ws), np.int64, int(n.sum()))
        padded = np.r_[words, np.zeros(2 * self.longest + 2, np.int64)]
        known = np.r_[0, np.cumsum(padded > 0)]
        base = np.cumsum(n) - n
        met: set[tuple[int, int, int]] = set()
        for least, enough, repetitions in self.classes:
            # an item begins where its first words stand, or up to its edits before a document that begins later
            first = np.arange(-least, len(words))
            full = known[np.maximum(first + least, 0)] - known[np.maximum(first, 0)] >= enough
            for r in repetitions:
                start = np.flatnonzero(full[least - r.offset : least - r.offset + len(words)])
                s, k = r.candidates(padded, start)
                met.update(zip((np.searchsorted(base, s, "right") - 1).tolist(), (s - r.offset).tolist(), k.tolist()))
        if not met:
            return []
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        exact: set[tuple[int, int, int]] = set()
        for doc, s, k in sorted(met):
            a, b = int(base[doc]), int(base[doc] + n[doc])
            if (doc, k, s - a) in exact:
                continue
            low, high = max(a, s - self.edits[k]), min(b, s + len(self.items[k]) + self.edits[k])
            near = words[low:high].tolist()
            if sum(map(self.matchers[k].forward.__contains__, near)) < len(self.items[k]) - self.edits[k]:
                continue  # too few words of the item
            e, x, y = self.matchers[k].best(near)
            if e <= self.edits[k]:
                found[doc, k].append((e, x + low - a, y + low - a))
                if not e:
                    exact.add((doc, k, x + low - a))
        out = []
        for (doc, k), spans in found.items():
            taken: list[tuple[int, int]] = []  # in order of position, none overlaps another
            for e, x, y in sorted(set(spans)):
                at = bisect.bisect_left(taken, (x, x))
                if (at == 0 or taken[at - 1][1] <= x) and (at == len(taken) or y <= taken[at][0]):
                    taken.insert(at, (x, y))
                    out.append((doc, k, x, y, e))
        return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.98, samples: int = 4, min_words: int = 1, seed: int = 7, max_block_words: int = 200_000) -> DataFrame:
    """One row for each passage of docs (doc_id, text) that is an item of benchmark (item_id, text), or nearly."""
    small_batches(docs.sparkSession)
    sized = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).withColumn("n", F.size(F.split("text", r"\s+")))
    total = sized.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / max_block_words))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))

    def search(block: int) -> DataFrame:
        items = [(r["item_id"], r["text"]) for r in sized.filter(F.col("block") == block).orderBy("item_id", "text").collect()]
        counts = Detector(items, similarity, recall, samples, min_words, seed).counts
        shared = docs.sparkSession.sparkContext.broadcast((items, counts))

        def run(batches):
            own, counts = shared.value
            detector = Detector(own, similarity, recall, samples, min_words, seed, counts)
            for ids, texts in text_blocks(batches, "doc_id", "text"):
                rows = [(ids[d], detector.ids[k], x, y, e, len(detector.items[k])) for d, k, x, y, e in detector.find([words_of(t) for t in texts])]
                columns = zip(*rows) if rows else ((),) * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *(pa.int32(),) * 4))], [f.split()[0] for f in SCHEMA.split(", ")])

        found = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
        if blocks > 1:
            found = Scratch(found).read()
            shared.unpersist()
        return found

    return reduce(DataFrame.unionByName, map(search, range(blocks)))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs less the rows that hold a benchmark passage. A row goes by its own text: another text of the same doc_id
    stays; rows that repeat a doc_id and text go together; rows without a doc_id stay."""
    keyed = with_text_keys(docs)
    found = find_contamination(keyed.filter("doc_id is not null").select(F.col(KEY).alias("doc_id"), "text"), benchmark, **how)
    return keyed.join(found.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").select(*docs.columns)
