"""Bounded-space online best-fit packing of tokenised documents into sequences.

Every document becomes its token ids and a closing id; what is longer than a sequence is cut into full pieces and a
rest. Full pieces are sequences of their own. The others are dealt by a hash of their document to packers, each of
which holds a fixed number of open bins, found through a bitset of free spaces: a piece goes to the fullest open bin
that takes it; if none does, it opens one, and when too many are open the fullest closes. A packer gets about
pieces_per_packer pieces, so the sequences left part-empty at its end stay a small share at any size.

Null texts count as empty: one piece that holds the closing id alone. Repeated rows and rows without a doc_id are
packed as rows of their own. Very long texts are encoded whole, one at a time. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, small_batches, text_blocks
from sparkloom.llm.token_count import Pieces, byte_symbols, read_vocabulary, remembered, split_pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


#: Of this Python worker: what it remembers of the vocabulary it used last.
ENCODERS: dict[str, Pieces] = {}


def encoder(vocabulary: str) -> Pieces:
    """Ids (little-endian, 4 bytes each) of pieces of text, as the tokenizers library gives them."""

    def make(vocabulary: str) -> Pieces:
        from tokenizers import Tokenizer

        tokenizer, symbols = Tokenizer.from_str(vocabulary), byte_symbols()
        model, coded = tokenizer.model, [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

        def ids_of(words: list[bytes]) -> list[bytes]:
            # letters and digits of ASCII stand for themselves
            texts = (w.decode() if w.isalnum() else "".join(map(symbols.__getitem__, w)) for w in words)
            return [b"".join([coded[t.id] for t in model.tokenize(t)]) for t in texts]

        return Pieces(vocabulary, ids_of, lambda i: np.array([i], "<u4").tobytes())

    return remembered(ENCODERS, vocabulary, make)


def encode_pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece of each document, with a checksum of its ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end, width = encoder(vocabulary.value), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for doc_ids, texts in text_blocks(batches, "doc_id", "text"):
            split = [split_pieces(t) for t in texts]
            value = pieces.of(set().union(*split))
            rows: list[tuple] = []
            for doc_id, words in zip(doc_ids, split):
                ids = b"".join(map(value.__getitem__, words)) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class OpenBins:
    """A fixed number of open bins; bit f of the set tells that a bin with f free places is open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open = capacity, most, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.set = 0
        self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.set >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.set & -self.set).bit_length() - 1)  # the fullest closes
            free, bin_id = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.free[left].append(bin_id)
            self.set |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free

    def _take(self, free: int) -> int:
        bin_id = self.free[free].pop()
        self.open -= 1
        if not self.free[free]:
            self.set &= ~(1 << free)
        return bin_id


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, open_bins: int = 4096, pieces_per_packer: int = 100_000) -> DataFrame:
    """All pieces with their sequence and their place in it."""
    small_batches(docs.sparkSession)
    pieces = Scratch(encode_pieces(docs, vocabulary_path, capacity)).read()
    packers = 1 + pieces.filter(F.col("length") < capacity).count() // pieces_per_packer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[int, OpenBins] = {}
        for batch in batches:
            packer, length = batch.column("packer").to_pylist(), batch.column("length").to_pylist()
            bins |= {p: OpenBins(capacity, open_bins) for p in set(packer) - bins.keys()}
            where = [bins[p].put(n) + (p,) for p, n in zip(packer, length)]
            sequence = pa.array([(p << 40) + b for b, _, p in where], pa.int64())
            offset = pa.array([at for _, at, _ in where], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), sequence, offset], [f.split()[0] for f in PACKED.split(", ")])

    # the hash deals pieces evenly, whatever the documents; its order also mixes their lengths
    dealt = pieces.filter(F.col("length") < capacity).withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(packers)))
    packed = dealt.repartition(packers, "packer").mapInArrow(run, PACKED)
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
