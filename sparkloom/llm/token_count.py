"""Token counts by rank-synchronous merging of arrays.

The vocabulary file is that of a BPE with word ends (lower case, white space dropped). A text's tokens are those of
its blank-separated pieces, as no pre-token holds white space, so a task counts each distinct piece once: pieces are
cut into pre-tokens, all new pre-tokens of a block form one ragged array of symbols, and in each round every sequence
merges its own pair of lowest rank wherever it occurs, until no sequence has a pair with a rank. What is left is
counted.

Nulls and empty texts have no tokens; repeated rows and rows without a doc_id are counted like others; other columns do
not matter. Very long texts are counted whole, one at a time; pieces of them that are long are not remembered.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkloom.llm.common import small_batches, text_blocks

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


class RankMerger:
    """Counts BPE symbols of many pre-tokens at a time."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.size = len(vocab)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, np.diff(keys[order]) != 0]
        self.keys, self.ranks, self.made = keys[order][first], order[first].astype(np.int64), made

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word."""
        none = np.iinfo(np.int64).max
        n = np.fromiter(map(len, words), np.int64, len(words))
        out = n.copy()
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(n) - 1
        sym[ends[n > 0]] = self.last[flat[ends[n > 0]]]
        seq = np.repeat(np.arange(len(words)), n)
        while len(sym) > 1:
            rank = np.where(seq[:-1] == seq[1:], self._rank(sym[:-1], sym[1:]), none)
            starts = np.flatnonzero(np.r_[True, np.diff(seq) != 0])
            lowest = np.repeat(np.minimum.reduceat(np.r_[rank, none], starts), np.diff(np.r_[starts, len(sym)]))
            live = lowest < none
            if not live.any():
                break
            # sequences that are done leave the arrays
            hit = (rank < none) & (rank == lowest[:-1])
            # in a run of overlapping pairs of the same symbol (a a a) every other one merges, from the left
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) != 1]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = live
            keep[at + 1] = False
            out -= np.bincount(seq[at], minlength=len(words))
            sym, seq = sym[keep], seq[keep]
        return out


def lower(text: str) -> str:
    """Lower case letter by letter, without the rule for a final sigma."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


class Kept(dict):
    """Values that stay, and behind them those of the present block."""

    def __init__(self):
        self.block: dict[str, Any] = {}

    def __missing__(self, piece: str) -> Any:
        return self.block[piece]


class Pieces:
    """A value for each blank-separated piece of text, added up from those of its pre-tokens.

    of_words gives the values of new pre-tokens (UTF-8), of_special that of a special token. The first max_pieces
    pieces and max_words pre-tokens of up to 40 letters are remembered, those after them only for their block.
    """

    def __init__(self, vocabulary: str, of_words: Callable[[list[bytes]], list], of_special: Callable[[int], Any], max_pieces: int = 200_000, max_words: int = 300_000):
        spec = json.loads(vocabulary)
        self.special = {t["content"]: of_special(t["id"]) for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pre_token = regex.compile(split["pattern"]["Regex"] + "|\\x20")  # blanks part the pieces
        self.total = b"".join if isinstance(of_special(0), bytes) else sum
        self.of_words, self.max_pieces, self.max_words = of_words, max_pieces, max_words
        self.kept: dict[str, Any] = {}
        self.words: dict[str, Any] = {}

    def _pre_tokens(self, texts: list[str]) -> list[str]:
        """Those of texts without blanks and special tokens, with a blank between two texts. All are brought to lower case
        and cut at once, as no letter or mark changes with what stands beyond a blank."""
        joined = " ".join(texts)
        return self.pre_token.findall(joined.lower() if joined.isascii() else lower(unicodedata.normalize("NFC", joined)))

    def _mixed(self, piece: str) -> list[str]:
        """Pre-tokens and special tokens of a piece."""
        return [x for k, part in enumerate(self.special_re.split(piece)) for x in ([part] if k % 2 else self._pre_tokens([part]))]

    def of(self, pieces: set[str]) -> dict[str, Any]:
        """The values of these pieces."""
        values = dict(zip(pieces, map(self.kept.get, pieces)))
        new = [p for p, v in values.items() if v is None]
        if not new:
            return values
        if self.special_re.search(" ".join(new)):
            mixed = {p for p in new if self.special_re.search(p)}
            new = [*(p for p in new if p not in mixed), *mixed]
            parts = self._pre_tokens(new[: -len(mixed)])
            for k, p in enumerate(mixed, len(new) - len(mixed)):
                parts += [" "] * (k > 0) + self._mixed(p)
        else:
            parts = self._pre_tokens(new)
        # no pre-token is a special token, as those mix signs and letters
        words = set(parts)
        own = dict(zip(words, map(self.words.get, words))) | self.special
        unseen = [w for w, v in own.items() if v is None and w != " "]
        fresh = dict(zip(unseen, self.of_words([w.encode() for w in unseen])))
        own |= fresh
        found, at = [], []
        for v in map(own.__getitem__, parts):  # None: a blank
            if v is not None:
                at.append(v)
            else:
                found.append(at[0] if len(at) == 1 else self.total(at))
                at.clear()
        found.append(self.total(at))
        values.update(zip(new, found))
        if room := max(0, self.max_words - len(self.words)):
            self.words.update(islice(((w, v) for w, v in fresh.items() if len(w) <= 40), room))
        if room := max(0, self.max_pieces - len(self.kept)):
            self.kept.update(islice(((p, v) for p, v in zip(new, found) if len(p) <= 40), room))
        return values


#: Of this Python worker: what it remembers of the vocabulary it used last.
COUNTERS: dict[str, Pieces] = {}


def remembered(of_worker: dict[str, Pieces], vocabulary: str, make: Callable[[str], Pieces]) -> Pieces:
    """One vocabulary's pieces at a time, so what a worker holds is bounded."""
    if vocabulary not in of_worker:
        of_worker.clear()
        of_worker[vocabulary] = make(vocabulary)
    return of_worker[vocabulary]


def counter(vocabulary: str) -> Pieces:
    def make(vocabulary: str) -> Pieces:
        merger = RankMerger(vocabulary)
        return Pieces(vocabulary, lambda words: merger.lengths(words).tolist() if words else [], lambda _: 1)

    return remembered(COUNTERS, vocabulary, make)


def read_vocabulary(path: str) -> str:
    """The driver reads the file (a few MB); tasks get its text."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def split_pieces(text: str | None) -> list[str]:
    return text.replace("\n", " ").split(" ") if text else []


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text)."""

    small_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(vocabulary.value)
        for ids, texts in text_blocks(batches, "doc_id", "text"):
            split = [split_pieces(t) for t in texts]
            value = pieces.of(set().union(*split))
            n = [sum(map(value.__getitem__, words)) for words in split]
            size = [len(t.encode("utf-8")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
