"""Texts cut into spans and blocks by bytes, and spans that lie next to each other taken together.

Both read rows in streams: a text is cut on its own, and of the spans of a chunk only the last combination is held, so
a chunk with very many spans needs no more memory than one with few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.adapters import small_batches

# Bounds of what is taken together.
BLOCK_BYTES = 12_000
MOST_CHARS, MOST_SPANS, MOST_BLANKS = 3_200, 4, 32

#: Bytes of spans that a task holds before it hands them on, and those that a span's own row takes.
OUT_BYTES, ROW_BYTES = 4_000_000, 500

BLOCKS = "block int, span int, start_byte long, end_byte long, span_sha256 string, block_sha256 string, text string"


def fragments(text: str, most: int) -> list[bytes]:
    """Lines with their ends; longer ones cut after at most so many bytes, never within a character."""
    out = []
    for line in text.splitlines(keepends=True):
        raw, at = line.encode(), 0
        while len(raw) - at > most:
            cut = at + most
            while cut > at and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            if cut == at:  # one character is longer than that
                cut += 1
                while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                    cut += 1
            out.append(raw[at:cut])
            at = cut
        if at < len(raw):
            out.append(raw[at:])
    return out


def packed(parts: list[bytes], most: int) -> list[list[bytes]]:
    """Parts in order in blocks of at most so many bytes, or of one longer part."""
    out: list[list[bytes]] = []
    size = most
    for part in parts:
        if not out or size + len(part) > most:
            out.append([])
            size = 0
        out[-1].append(part)
        size += len(part)
    return out


def byte_blocks(texts: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, sha_col: str | None = None) -> DataFrame:
    """The spans of each text with the block that each lies in: numbers from 1, places in bytes, hashes of both.
    Null and empty texts have none; rows that repeat an id are cut one by one. With sha_col, a text with another hash
    than stated there is an error."""
    if block_bytes <= 0:
        raise ValueError("blocks hold at least a byte")
    text: Column = F.col(text_col)
    if sha_col:
        text = F.when(F.sha2(text_col, 256) == F.col(sha_col), text).otherwise(F.when(text.isNotNull(), F.raise_error(F.lit("a text has another hash than stated"))))

    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def out(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ((),) * len(kinds)
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", *(c.split()[0] for c in BLOCKS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0
            for i, t in enumerate(batch.column("text")):
                t, place, n = t.as_py(), 0, 0
                for k, block in enumerate(packed(fragments(t, block_bytes) if t else [], block_bytes), 1):
                    whole = hashlib.sha256(b"".join(block)).hexdigest()
                    for part in block:
                        n += 1
                        at.append(i)
                        rows.append((k, n, place, place + len(part), hashlib.sha256(part).hexdigest(), whole, part.decode()))
                        place += len(part)
                        held += len(part) + ROW_BYTES
                        if held >= OUT_BYTES:
                            yield out(batch, at, rows)
                            at, rows, held = [], [], 0
            yield out(batch, at, rows)

    kind = texts.schema[id_col].dataType.simpleString()
    small_batches(texts.sparkSession)
    return texts.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, {BLOCKS}").withColumnRenamed("id", id_col)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combines sorted spans (chunk_id, start, end, span_id, blanks before) with the last combination while they fit."""
    last: list | None = None
    for batch in batches:
        done = []
        for chunk, start, end, span, blanks in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "start", "end", "span_id", "blanks"))):
            if last and last[0] == chunk:
                near = start <= last[2] or start - last[2] <= min(blanks, MOST_BLANKS)
                size, ids = max(last[2], end) - last[1], last[3] if span in last[3] else [*last[3], span]
                if near and size <= MOST_CHARS and len(ids) <= MOST_SPANS:
                    last[2], last[3] = max(last[2], end), ids
                    continue
            if last:
                done.append(last)
            last = [chunk, start, end, [span]]
        yield _combined(done)
    if last:
        yield _combined([last])


def _combined(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    columns = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["chunk_id", "start", "end", "source_span_ids"])


def coalesced(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans (chunk_id, span_id, start, end in code points) of one chunk that overlap, touch, or have at most 32 blanks
    between them, taken together up to 3,200 characters and four spans; each with its text and the text's hash.
    chunks: chunk_id, text, one row each. A span of an unknown chunk is an error; a repeated span counts once."""
    text = F.when(F.col("text").isNull(), F.raise_error(F.lit("a span is of an unknown chunk"))).otherwise(F.col("text"))
    before = F.substring(text, F.greatest(F.col("start") - MOST_BLANKS, F.lit(0)).cast("int") + 1, F.least(F.col("start"), F.lit(MOST_BLANKS)).cast("int"))
    blanks = F.length(F.regexp_extract(before, r"((?U)[\s\x1c-\x1f]*)$", 1))
    placed = spans.select("chunk_id", "span_id", "start", "end").distinct().join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    rows = placed.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("span_id").cast("string").alias("span_id"), blanks.alias("blanks"))
    small_batches(spans.sparkSession)
    merged = rows.repartition("chunk_id").sortWithinPartitions("chunk_id", "start", "end", "span_id").mapInArrow(_fold, "chunk_id string, start long, end long, source_span_ids array<string>")
    known = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text")
    shown = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return merged.join(known, "chunk_id").select("chunk_id", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), "source_span_ids", shown.alias("text"), F.sha2(shown, 256).alias("text_sha256"))
