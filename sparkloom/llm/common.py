"""What the operators of this subpackage share: scratch tables, Arrow batches cut to a size, word hashes."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task handles at a time; bounds the arrays made from them.
BLOCK_CHARS = 1_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """A table written to the shared folder: it cuts the lineage and outlives lost executors."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/scratch-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        """Only once all that reads it has been written."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession, size: int = 4_000_000) -> None:
    """Sends rows to Python in batches of this many bytes, or of one longer row. A caller's own setting stays."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(size))


#: The column of with_text_keys.
KEY = "_text_key"


def with_text_keys(docs: DataFrame) -> DataFrame:
    """docs with a number for each doc_id and text: the doc_id, but where one has several texts, hashes for all of them but
    one. Null where there is no doc_id. Only the ids that stand with several texts are joined."""
    hashed = docs.withColumn(KEY, F.xxhash64("text"))
    several = hashed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(KEY).alias("_text_key_first"), F.max(KEY).alias("_text_key_last")).filter("_text_key_first <> _text_key_last")
    # written first, so that its size is known and texts aren't shuffled for a few ids, or none
    known = Scratch(several.select(F.col("doc_id").alias("_text_key_id"), "_text_key_first")).read()
    if known.isEmpty():
        return docs.withColumn(KEY, F.col("doc_id"))
    joined = hashed.join(known, F.col("doc_id") == F.col("_text_key_id"), "left")
    return joined.withColumn(KEY, F.when(F.col("_text_key_first") < F.col(KEY), F.xxhash64("doc_id", KEY)).otherwise(F.col("doc_id"))).drop("_text_key_id", "_text_key_first")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_blocks(batches: Iterator[pa.RecordBatch], id_col: str | tuple[str, ...], text_col: str, max_chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) of at most max_chars characters, or of one longer text; several id columns give tuples."""
    for batch in batches:
        ids = batch.column(id_col).to_pylist() if isinstance(id_col, str) else list(zip(*(batch.column(c).to_pylist() for c in id_col)))
        texts = batch.column(text_col).to_pylist()
        start, chars = 0, 0
        for i, text in enumerate(texts):
            n = len(text) if text else 0
            if chars + n > max_chars and i > start:
                yield ids[start:i], texts[start:i]
                start, chars = i, 0
            chars += n
        if start < len(texts):
            yield ids[start:], texts[start:]


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered for at most max_words words at a time."""

    def __init__(self, max_words: int = 150_000):
        self.max_words = max_words

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.max_words:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RollingHash:
    """Polynomial hashes of all runs of words of a block, modulo 2**64, by prefix sums."""

    def __init__(self, base: int):
        assert base % 2
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, 2 * len(self.powers))
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, self.base, np.uint64)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, self.inverse, np.uint64)])

    def prefix(self, words: np.ndarray) -> np.ndarray:
        self._grow(len(words))
        return np.r_[np.uint64(0), np.cumsum(words * self.powers[: len(words)])]

    def runs(self, prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the runs of length words that begin at start."""
        return mix((prefix[start + length] - prefix[start]) * self.inverses[start])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int = 1, most: int = 100_000) -> Iterator[dict[str, pa.Array]]:
    """Runs of whole groups, of about most rows each, from batches sorted by their first columns (the keys)."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def columns(parts: list[pa.RecordBatch]) -> dict[str, pa.Array]:
        table = pa.Table.from_batches(parts)
        return {name: table.column(name).combine_chunks() for name in table.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= most:  # close before the last group that this batch begins or goes on with
            key = [batch.column(k)[0] for k in range(keys)]
            new = [h.column(k)[h.num_rows - 1] for h in held[-1:] for k in range(keys)]
            if key != new:
                yield columns(held)
                held, rows = [], 0
            else:
                cut = np.flatnonzero(np.logical_or.reduce([batch.column(k).to_numpy(zero_copy_only=False) != key[k].as_py() for k in range(keys)]))
                if len(cut):
                    yield columns([*held, batch.slice(0, int(cut[0]))])
                    held, rows, batch = [], 0, batch.slice(int(cut[0]))
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield columns(held)
