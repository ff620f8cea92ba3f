import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing, token_count
from tests.llm.helpers import ODD, docs_frame, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [*ODD, "The quick brown fox, isn't it? 12345 aaaa hahahahaha", "lorem ipsum " * 3000, "It's I'LL we've\n\nNEW lines"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, library):
    rows = token_count.count_tokens(with_clashes(docs_frame(spark, TEXTS)), PATH, limit=2048).collect()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert [r["n_tokens"] for r in sorted(rows, key=lambda r: r["doc_id"])] == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    assert {r["doc_id"]: r["n_bytes"] for r in rows} == {i: len((t or "").encode()) for i, t in enumerate(TEXTS)}


def test_counts_beyond_the_memory_for_pieces(library):
    pieces = token_count.counter(token_count.read_vocabulary(PATH))
    small = token_count.Pieces(token_count.read_vocabulary(PATH), pieces.of_words, lambda _: 1, max_pieces=4)
    for text in TEXTS * 2:
        split = token_count.split_pieces(text)
        value = small.of(set(split))
        assert sum(map(value.__getitem__, split)) == len(library.encode(text or "", add_special_tokens=False).ids)


def test_words_are_remembered_beyond_the_pieces(library):
    pieces, asked = packing.encoder(token_count.read_vocabulary(PATH)), []

    def ids_of(words):
        asked.extend(words)
        return pieces.of_words(words)

    small = token_count.Pieces(token_count.read_vocabulary(PATH), ids_of, lambda i: np.array([i], "<u4").tobytes(), max_pieces=4)
    texts = ["Ice-sheet, été. \u0301x ΑΣ Σ", "ice été x<|endoftext|>y <|endoftext|> <|END|> a\u0301 \u01c5", "<|endoftext|>", "", "1٣²\x00"]
    for _ in range(2):
        for text in texts:
            split = token_count.split_pieces(text)
            value = small.of(set(split))
            assert np.frombuffer(b"".join(map(value.__getitem__, split)), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked))


def test_lengths_of_overlapping_pairs(library):
    merger = token_count.RankMerger(token_count.read_vocabulary(PATH))
    for word in ("aaaaaaa", "hahahaha", "thethethe", "a", "ab"):
        assert merger.lengths([word.encode()])[0] == len(library.encode(word).ids)


def test_packing_is_whole_and_gapless(spark, library):
    texts = TEXTS + [f"w{i} " * (i % 400) for i in range(300)]
    rows = packing.pack(with_clashes(docs_frame(spark, texts)), PATH, capacity=256, open_bins=16, pieces_per_packer=100).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        for r in own:
            part = ids[r["start"] : r["start"] + 256]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in own) == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256


def test_few_sequences():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2048, 20_000).tolist()
    bins = packing.OpenBins(2048, 4096)
    for s in sizes:
        bins.put(s)
    assert bins.made <= 1.03 * sum(sizes) / 2048


def test_the_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the third opens once the one with 7 has closed
    assert bins.put(3) == (0, 6)
    assert bins.put(2) == (2, 8)


def test_empty_table(spark):
    empty = docs_frame(spark, [])
    assert token_count.count_tokens(empty, PATH).count() == 0
    assert packing.pack(empty, PATH).count() == 0
