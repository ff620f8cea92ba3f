"""Runs of words: maximal stretches that repeat with a smallest period.

By the runs theorem every run of exponent two or more has a root that is the longest Lyndon word at its place under an
order of the words or under the opposite one. A document is scanned from right to left under both: the next smaller
suffix of each word is found on the stack of those behind it. Suffixes whose first words agree are compared by their
longest common extension: some words directly, then a rolling hash (modulo 2**61 - 1) galloping and bisecting. Roots
that stand at least three times in a row, and not once more before, are extended by the same means to both sides, and
what comes out is held against the words themselves before it counts. There is no suffix array. Time is n log n for n
words, whatever they repeat; memory is a few lists of one document.

Null and empty texts have no words and no runs. Rows are taken one by one: repeated rows, null ids and rows of one
doc_id with other texts give a row each; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches, text_blocks

MODULUS = 2**61 - 1
BASE = 0x12DEADBEEF_C0DE5 % MODULUS
#: Words compared one by one before hashes are asked.
DIRECT = 12

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
SCHEMA = f"doc_id long, n_words long, runs {RUNS}, kept_text string"


class Words:
    """Words of one document as small numbers, with longest common extensions to both sides."""

    def __init__(self, words: list[bytes]):
        number: dict[bytes, int] = {}
        self.ids = [number.setdefault(w, len(number)) for w in words]
        self.n = len(words)
        self._hashes: list[int] | None = None
        self._powers: list[int] = []

    def _hashed(self) -> tuple[list[int], list[int]]:
        if self._hashes is None:
            self._hashes = list(accumulate(self.ids, lambda h, x: (h * BASE + x + 1) % MODULUS, initial=0))
            self._powers = list(accumulate(range(self.n), lambda p, _: p * BASE % MODULUS, initial=1))
        return self._hashes, self._powers

    def after(self, i: int, j: int) -> int:
        """How many words from i < j on equal those from j on."""
        ids, n = self.ids, self.n
        most = n - j
        near = min(most, DIRECT)
        for k in range(near):
            if ids[i + k] != ids[j + k]:
                return k
        if near == most:
            return most
        hashes, powers = self._hashed()

        def equal(a: int, length: int) -> bool:
            p = powers[length]
            return (hashes[i + a + length] - hashes[i + a] * p - hashes[j + a + length] + hashes[j + a] * p) % MODULUS == 0

        low, step = near, near
        while low + step <= most and equal(low, step):
            low += step
            step *= 2
        high = min(step, most - low + 1)  # the stretch of this length differs, or passes the end
        done = 0
        while high - done > 1:
            mid = (done + high) // 2
            if equal(low + done, mid - done):
                done = mid
            else:
                high = mid
        return low + done

    def before(self, i: int, j: int) -> int:
        """How many words before i < j equal those before j."""
        ids, most = self.ids, i
        near = min(most, DIRECT)
        for k in range(1, near + 1):
            if ids[i - k] != ids[j - k]:
                return k - 1
        if near == most:
            return most
        hashes, powers = self._hashed()

        def equal(a: int, length: int) -> bool:
            p, x, y = powers[length], i - a, j - a
            return (hashes[x] - hashes[x - length] * p - hashes[y] + hashes[y - length] * p) % MODULUS == 0

        low, step = near, near
        while low + step <= most and equal(low, step):
            low += step
            step *= 2
        high, done = min(step, most - low + 1), 0
        while high - done > 1:
            mid = (done + high) // 2
            if equal(low + done, mid - done):
                done = mid
            else:
                high = mid
        return low + done


def next_smaller(words: Words, ids: list[int]) -> list[int]:
    """For each place the next one whose suffix is smaller (a suffix is larger than its own beginnings), n if none: the
    longest Lyndon word there ends before it. The places reached from i + 1 by these links are the stack. ids: the
    words' numbers in the order asked for."""
    n, after = words.n, words.after
    link = [n] * (n + 1)
    known: dict[tuple[int, int], int] = {}  # extensions of (place, distance), so that a short root is not extended anew at each place
    for i in range(n - 2, -1, -1):
        x, j = ids[i], i + 1
        while j < n:
            y = ids[j]
            if y < x:
                break
            if y == x:
                p = j - i
                k = known.get((j, p)) if p <= DIRECT else None
                k = after(i, j) if k is None or ids[i:j] != ids[j : j + p] else p + k
                if p <= DIRECT:
                    known[i, p] = k
                if j + k == n or ids[j + k] < ids[i + k]:
                    break
            j = link[j]
        link[i] = j
    return link


def find_runs(words: list[bytes], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least min_length words and min_exponent periods, which is three or more."""
    if min_exponent < 3:
        raise ValueError("roots are looked for where they stand three times at least")
    n = len(words)
    if n < max(min_length, min_exponent):
        return []
    text = Words(words)
    ids = np.asarray(text.ids, np.int64)
    opposite = [-x for x in text.ids]
    places = np.arange(n)
    roots: set[tuple[int, int]] = set()
    for order in (text.ids, opposite):
        period = np.asarray(next_smaller(text, order)[:n], np.int64) - places
        # the first root of a run begins less than a period after its start, so all but one of the exponent's periods follow
        ok = np.flatnonzero(places + (min_exponent - 1) * period < n)
        for k in range(min_exponent - 2):  # a look at the first and last word of each copy
            for last in (0, 1):
                at = ok + k * period[ok] + (period[ok] - 1) * last
                ok = ok[ids[at] == ids[at + period[ok]]]
        roots.update(zip(ok.tolist(), period[ok].tolist()))
    found: set[tuple[int, int, int]] = set()
    for i, p in sorted(roots):
        if (i - p, p) in roots and text.ids[i - p : i] == text.ids[i : i + p]:
            continue  # not the first root of its run
        if (ahead := text.after(i, i + p)) < (min_exponent - 2) * p:
            continue
        back = text.before(i, i + p)
        start, length = i - back, back + p + ahead
        if length >= max(min_length, min_exponent * p):
            found.add((start, length, p))
    return sorted((r for r in found if holds(ids, *r)), key=lambda r: (r[0], r[2]))


def holds(ids: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether the words themselves have this period here, and no neighbour goes on with it."""
    end = start + length
    return (
        bool((ids[start : end - period] == ids[start + period : end]).all())
        and (start == 0 or ids[start - 1] != ids[start - 1 + period])
        and (end == len(ids) or ids[end] != ids[end - period])
    )


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def detect(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, the runs by start and then period, and the text that is left (words joined by one space) when of
    each run only the first period stays; for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for ids, texts in text_blocks(batches, "doc_id", "text"):
            counts, runs, kept = [], [], []
            for text in texts:
                words = text.encode().split() if text else []
                found = find_runs(words, min_length, min_exponent)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(b" ".join(collapse(words, found)).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "kept_text"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """For each row of detect(): the number of runs, the one of greatest exponent (ties: smallest start, then period),
    digests of all runs and of the text that is left."""
    r = "runs"
    # length / period of a and b as exact fractions
    best = F.expr(
        f"aggregate({r}, cast(null as struct<start: bigint, length: bigint, period: bigint>), (a, b) -> if(a is null or b.length * a.period > a.length * b.period, b, a))"
    )
    lines = F.expr(f"array_join(transform({r}, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size(r).cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def repeat_some(doc_id: Column, text: Column) -> Column:
    """The text with planted runs: in a tenth of the documents, chosen by the crc32 of the id, a stretch of words from a
    place on is repeated to the end."""
    h = F.crc32(doc_id.cast("string"))
    g = (h / 10).cast("long")
    w = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def repeated(s: Column) -> Column:
        n, g = F.size(s["w"]), s["g"]
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(s["w"], lambda _, i: F.get(s["w"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    some = F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.struct(w.alias("w"), g.alias("g")))
    return F.coalesce(F.get(F.transform(F.array(some), lambda s: F.when(s.isNotNull(), repeated(s))), F.lit(0)), text)
