"""Exact removal of long word sequences that occur more than once, by suffix automata of reference shards.

A window is `length` consecutive words of one document; a window is repeated if its word sequence also starts
elsewhere. Every word that a repeated window covers is removed; windows are judged on the input.

An automaton of all documents would grow with the corpus, so the reference is cut into shards by content instead of
being broadcast: each window belongs to its minimizer (its `gram`-word sequence that comes first in a fixed order, the
leftmost of equal ones), equal windows to equal minimizers. Runs of windows with one minimizer are passages. In that
order sequences that a bounded sample of documents shows to be frequent come last, so the edges of a passage that very
many documents hold belong to what stands beside it, and only equal windows meet at a frequent minimizer:

1. tasks send (minimizer, document, place) of each passage, no text, and only one row for a minimizer that a block
   of documents holds several times; minimizers that occur once vanish;
2. the words of the passages left are read again and sent to the shard of their minimizer, equal passages of a block
   of documents as one row with all its places, so a passage that many documents hold stays small;
3. a shard comes sorted by minimizer; for each it builds a suffix automaton of the distinct passages with counts,
   streams every passage for its matching statistics, and returns the spans of windows that occur at least twice;
4. spans meet their documents, and what is left is digested.

Words are compared as they are, so hashes only route. A row is known by doc_id and a hash of its text, so rows that
repeat a doc_id are texts of their own, and copies of each other if the texts are equal. Null, empty and short texts
keep all they have, and so do rows without a doc_id. Very long texts are cut like others, one at a time. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import RollingHash, WordHashes, mix, shuffle_partitions, small_batches, sorted_groups, text_blocks

I64, I32 = pa.int64(), pa.int32()
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return text.encode("utf-8").split() if text else []


class Passages:
    """Cuts documents into runs of windows that share a minimizer; frequent: hashes, sorted, that come last."""

    def __init__(self, length: int, gram: int, frequent: np.ndarray):
        self.length, self.gram, self.frequent = length, gram, frequent
        self.maybe = np.zeros(1 << 20, bool)  # by the first bits of a hash: most are told apart without a search
        self.maybe[frequent >> np.uint64(44)] = True
        self.hashes, self.rolling = WordHashes(), RollingHash(0xD6E8FEB86659FD93)

    def grams(self, prefix: np.ndarray) -> np.ndarray:
        return mix(self.rolling.runs(prefix, np.arange(max(0, len(prefix) - self.gram)), self.gram) ^ np.uint64(0xA5A5A5A5A5A5A5A5))

    def distinct(self, docs: list[list[bytes]]) -> np.ndarray:
        """Hashes of the grams of documents, one for each document that holds it."""
        own = [np.unique(self.grams(self.rolling.prefix(self.hashes.of(ws)))) for ws in docs if len(ws) >= self.gram]
        return np.concatenate(own) if own else np.zeros(0, np.uint64)

    def of(self, docs: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """(document index, first word, number of windows, minimizer) of each passage."""
        n = np.fromiter(map(len, docs), np.int64, len(docs))
        windows = np.maximum(n - self.length + 1, 0)
        if not windows.any():
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        prefix = self.rolling.prefix(self.hashes.of([w for ws in docs for w in ws]))
        grams = self.grams(prefix)
        bits = np.uint64(max(1, int(len(grams)).bit_length()))
        key = ((grams >> np.uint64(1)) >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # ties go to the left
        met = np.flatnonzero(self.maybe[grams >> np.uint64(44)])
        if len(met):
            own = grams[met]
            met = met[self.frequent[np.minimum(np.searchsorted(self.frequent, own), len(self.frequent) - 1)] == own]
            key[met] |= np.uint64(1 << 63)
        least, span, need = key, 1, self.length - self.gram + 1
        while span < need:  # sliding minimum by doubling
            step = min(span, need - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        doc = np.repeat(np.arange(len(docs)), windows)
        base = np.cumsum(n) - n
        within = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = (least[base[doc] + within] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(doc) != 0)])
        return doc[new], within[new], np.diff(np.r_[new, len(doc)]), grams[at[new]]


class SuffixAutomaton:
    """Of several word sequences, each with a count; a state knows how often its sequences end."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, nxt: dict[bytes, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the sequences of q no longer than those of p and a word."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], count: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                p, new = last, self._state(self.length[last] + 1, {}, 0)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            self.count[last] += count

    def close(self) -> None:
        """Hands counts down to shorter suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list[bytes], length: int) -> Iterator[int]:
        """Starts of the windows that occur twice at least, from the matching statistics."""
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.length[self.link[state]] >= length:
                state = self.link[state]
                matched = self.length[state]
            if matched >= length and self.count[state] >= 2:
                yield i - length + 1


def spans_of(starts: list[int], length: int) -> list[tuple[int, int]]:
    """Word spans that windows at these starts cover, joined where they touch."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + length)
        else:
            out.append((s, s + length))
    return out


#: A minimizer's only passage in a block; one of several; the word to other blocks that there are several.
ONE, SEVERAL, WORD = 0, 1, 2


def frequent_grams(docs: DataFrame, gram: int, sample_docs: int, least: int, most: int) -> np.ndarray:
    """Hashes, sorted, of the grams of at least so many of about sample_docs documents: the most frequent, at most so many."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * share))

    def emit(batches):
        cutter = Passages(gram, gram, np.zeros(0, np.uint64))
        for _, texts in text_blocks(batches, "doc_id", "text"):
            h, c = np.unique(cutter.distinct([words_of(t) for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    counted = sample.mapInArrow(emit, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    return np.sort(counted.orderBy(F.desc("c"), "h").limit(most).select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))


def find_passages(docs: DataFrame, length: int, gram: int, frequent: np.ndarray) -> DataFrame:
    """Passages with their minimizers. A minimizer that a block holds several times is known to repeat: its passages
    need no judging, and one row tells the other blocks, so a hot one reaches its judge as a row per block."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        cutter = Passages(length, gram, shared.value)
        for keys, texts in text_blocks(batches, ("doc_id", "th"), "text"):
            doc, start, n, grams = cutter.of([words_of(t) for t in texts])
            m, at, count = np.unique(grams.view(np.int64), return_inverse=True, return_counts=True)
            again = m[count > 1]
            none = np.zeros(len(again), np.int64)
            own = [np.r_[np.fromiter((k[i] for k in keys), np.int64, len(keys))[doc], none] for i in (0, 1)]
            columns = (np.r_[m[at], again], *own, np.r_[start, none].astype(np.int32), np.r_[n, none].astype(np.int32), np.r_[np.where(count[at] > 1, SEVERAL, ONE), none + WORD].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["m", "doc_id", "th", "start", "n", "kind"])

    return docs.mapInArrow(run, "m long, doc_id long, th long, start int, n int, kind int")


def _met_twice(batches):
    """Passages whose minimizer another passage has."""
    for cols in sorted_groups(batches):
        m, kind = cols["m"].to_numpy(), cols["kind"].to_numpy()
        alone = np.flatnonzero(kind != SEVERAL)
        same = m[alone][1:] == m[alone][:-1]
        met = alone[np.r_[False, same] | np.r_[same, False]] if len(alone) else alone
        keep = pa.array(np.r_[np.flatnonzero(kind == SEVERAL), met[kind[met] == ONE]])
        yield pa.RecordBatch.from_arrays([cols[c].take(keep) for c in ("m", "doc_id", "th", "start", "n")], ["m", "doc_id", "th", "start", "n"])


def _read_passages(length: int):
    """Words of passages, equal ones of a block as one row with all its places."""

    def run(batches):
        for batch in batches:
            lists = batch.column("passages").to_pylist()
            at = 0
            for keys, texts in text_blocks([batch], ("doc_id", "th"), "text"):
                met: dict[tuple[int, bytes], tuple[list[int], list[int], list[int]]] = {}
                for (doc_id, th), text, passages in zip(keys, texts, lists[at : at + len(keys)]):
                    own = {(p["m"], p["start"], p["n"]) for p in passages or () if p["th"] == th}
                    words = words_of(text) if own else []
                    copies = sum(p["th"] == th for p in passages or ()) // max(1, len(own))  # equal rows bring each passage once a row
                    for m, start, n in own:
                        docs, ths, starts = met.setdefault((m, b" ".join(words[start : start + n - 1 + length])), ([], [], []))
                        for _ in range(min(2, copies)):
                            docs.append(doc_id)
                            ths.append(th)
                            starts.append(start)
                at += len(keys)
                columns = zip(*met.values()) if met else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in met], I64), pa.array([k[1] for k in met], pa.binary()), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, (I64, I64, I32)))],
                    ["m", "words", "docs", "ths", "starts"],
                )

    return run


def _judge_shard(length: int):
    def run(batches):
        for cols in sorted_groups(batches, most=2_000):
            groups: dict[int, dict[bytes, list[tuple[list[int], list[int], list[int]]]]] = {}
            for m, words, *places in zip(*(c.to_pylist() for c in cols.values())):
                groups.setdefault(m, {}).setdefault(words, []).append(places)
            out: list[tuple[int, int, int, int]] = []
            for passages in groups.values():
                count = {words: sum(len(d) for d, _, _ in places) for words, places in passages.items()}
                split = {words: words.split(b" ") for words in passages}
                if len(passages) == 1:
                    found = {words: [(0, len(split[words]))] for words, n in count.items() if n > 1}
                else:
                    automaton = SuffixAutomaton()
                    for words, n in count.items():
                        automaton.add(split[words], n)
                    automaton.close()
                    found = {words: spans_of(list(automaton.repeated(split[words], length)), length) for words in passages}
                for words, spans in found.items():
                    for a, b in spans:
                        for docs, ths, starts in passages[words]:
                            out += [(d, t, s + a, s + b) for d, t, s in zip(docs, ths, starts)]
                            if len(out) > 100_000:
                                yield _spans(out)
                                out = []
            if out:
                yield _spans(out)

    return run


def _spans(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (I64, I64, I32, I32))], ["doc_id", "th", "a", "b"])


def repeated_spans(keyed: DataFrame, length: int = 35, gram: int = 8, sample_docs: int = 10_000, least: int = 3, most: int = 500_000) -> DataFrame:
    """doc_id, th, a, b: spans of words that repeated windows cover, of rows (doc_id, th: a hash of the text, text)."""
    parts = shuffle_partitions(keyed.sparkSession)
    known = keyed.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    judge = F.when(F.col("kind") == SEVERAL, F.xxhash64("m", "doc_id")).otherwise(F.col("m"))
    frequent = frequent_grams(known, gram, sample_docs, least, most)
    again = find_passages(known, length, gram, frequent).repartition(parts, judge).sortWithinPartitions("m").mapInArrow(_met_twice, "m long, doc_id long, th long, start int, n int")
    by_doc = again.groupBy("doc_id").agg(F.collect_list(F.struct("th", "m", "start", "n")).alias("passages"))
    # a left join like the last one, so that Spark shuffles the texts once for both
    joined = keyed.join(by_doc, "doc_id", "left").select("doc_id", "th", F.when(F.col("passages").isNotNull(), F.col("text")).alias("text"), "passages")
    passages = joined.mapInArrow(_read_passages(length), "m long, words binary, docs array<long>, ths array<long>, starts array<int>")
    return passages.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(_judge_shard(length), "doc_id long, th long, a int, b int")


def remove_repeated(docs: DataFrame, length: int = 35, gram: int = 8, **sample) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words kept (joined by blanks) of each row of docs."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    spans = repeated_spans(keyed, length, gram, **sample).groupBy("doc_id").agg(F.collect_list(F.struct("th", "a", "b")).alias("spans"))

    def run(batches):
        for batch in batches:
            lists = batch.column("spans").to_pylist()
            at = 0
            for keys, texts in text_blocks([batch], ("doc_id", "th"), "text"):
                rows = []
                for (_, th), text, spans in zip(keys, texts, lists[at : at + len(keys)]):
                    kept = words = words_of(text)
                    if spans:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for s in spans:
                            if s["th"] == th:
                                gone[s["a"]] += 1
                                gone[s["b"]] -= 1
                        kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                at += len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], I64), *(pa.array(c, t) for c, t in zip(zip(*rows), (I64, I64, pa.string())))], [f.split()[0] for f in KEPT.split(", ")])

    return keyed.join(spans, "doc_id", "left").mapInArrow(run, KEPT)
