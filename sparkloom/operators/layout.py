"""Pages from the geometry of their lines: reading order, paragraphs, running heads, headings, sections.

Lines have a document, a page, a box (x0, x1, y0, y1), a text, and the page's width and height. A page's lines are put
in order by one task, pages being small; all else is aggregations and windows within a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.adapters import small_batches

# Shares of a page or a line's height that part columns, bands, paragraphs and margins, and headings.
COLUMN_GAP, LEAST_COLUMN_GAP, BAND_GAP, PARAGRAPH_GAP, INDENT, SHORT_LINE = 0.010, 5.0, 1.6, 0.55, 0.018, 0.90
HEAD_PAGES, HEAD_SHARE, MARGIN, HEAD_CHARACTERS = 3, 0.4, 0.08, 200
HEADING_CHARACTERS, HEADING_LINES, HEADING_HEIGHT = 140, 3, 1.08
BROKEN_WORD = re.compile("(?<=[^\\W\\d_])[-\u2010\u00ad]$")
NUMBERED = r"^([0-9]+(?:\.[0-9]+)*)\.?\s+(\S.*)$"
CAPTION = r"(?i)^\s*(?:supplementary\s+)?(?:fig(?:ure)?\.?|table|scheme|extended data)\s*[0-9ivx]+"
HEADINGS = (
    "abstract|acknowledgement|acknowledgements|acknowledgments|appendix|author contributions|availability of data and materials|background|code availability|competing interests|conclusion|conclusions"
    "|conclusions and outlook|data availability|data availability statement|discussion|experimental section|funding|highlights|introduction|keywords|limitations|materials|materials and methods|method"
    "|methodology|methods|methods and materials|plain language summary|references|references cited|result|results|results and discussion|significance|study area|study site|summary"
    "|supplementary information|supplementary material|supporting information|theory"
).split("|")

BLOCK = "doc_id long, page int, place int, x0 double, x1 double, y0 double, y1 double, line_count int, text string, page_height double"
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


class Line(NamedTuple):
    doc_id: int
    page: int
    x0: float
    x1: float
    y0: float
    y1: float
    text: str
    page_width: float
    page_height: float


def runs(rows: list, low: str, high: str, gap: float) -> list[list]:
    """Rows in groups with more than a gap between them along an axis."""
    out: list[list] = []
    reach = 0.0
    for r in sorted(rows, key=lambda r: (getattr(r, low), getattr(r, high))):
        if out and getattr(r, low) - reach <= gap:
            out[-1].append(r)
            reach = max(reach, getattr(r, high))
        else:
            out.append([r])
            reach = getattr(r, high)
    return out


def typical_height(rows: list) -> float:
    heights = [h for r in rows if (h := r.y1 - r.y0) > 0]
    return median(heights) if heights else 1.0


def in_reading_order(rows: list, width: float) -> list[list]:
    """Bands of columns as a reader follows them: cut between columns and between bands in turn, until nothing parts."""
    axes = {"x": ("x0", "x1", max(LEAST_COLUMN_GAP, width * COLUMN_GAP)), "y": ("y0", "y1", typical_height(rows) * BAND_GAP)}
    done: list[list] = []
    todo = [(rows, "x")]
    while todo:
        own, axis = todo.pop()
        for a in (axis, "y" if axis == "x" else "x"):
            parts = runs(own, *axes[a])
            if len(parts) > 1:
                todo += [(p, "y" if a == "x" else "x") for p in reversed(parts)]
                break
        else:
            done.append(sorted(own, key=lambda r: (r.y0, r.x0)))
    return done


def breaks_word(text: str) -> bool:
    """Whether a text ends within a word; its last characters tell, and a search of all of it would be slow."""
    return bool(BROKEN_WORD.search(text[-3:]))


def paragraphs(rows: list, width: float) -> list[list]:
    """Lines of one band in paragraphs: parted by a gap, an indent, or a short line before; never within a word."""
    height, left, right = typical_height(rows), min(r.x0 for r in rows), max(r.x1 for r in rows)
    indent = max(4.0, width * INDENT)
    out = [[rows[0]]]
    for before, r in zip(rows, rows[1:]):
        within = breaks_word(before.text) and r.text[:1].islower()
        short = before.x1 - left < max(1.0, right - left) * SHORT_LINE and before.x1 < right - indent
        if not within and (r.y0 - before.y1 > height * PARAGRAPH_GAP or r.x0 - left > indent or short):
            out.append([])
        out[-1].append(r)
    return out


def joined(texts: list[str]) -> str:
    """One text of lines; a word that a hyphen breaks is whole again."""
    out = ""
    for t in filter(None, map(str.strip, texts)):
        out = out[:-1] + t if breaks_word(out) and t[:1].islower() else f"{out} {t}".strip()
    return " ".join(out.replace("\u00ad", "").split())


def _page(rows: list[Line]) -> list[tuple]:
    """The paragraphs of one page's lines, in reading order, as rows of BLOCK."""
    first = rows[0]
    width, height = float(first.page_width), float(first.page_height)
    parts = [p for band in in_reading_order(rows, width) for p in paragraphs(band, width)]
    return [
        (first.doc_id, first.page, i, min(r.x0 for r in p), max(r.x1 for r in p), min(r.y0 for r in p), max(r.y1 for r in p), len(p), joined([r.text for r in p]), height)
        for i, p in enumerate(parts)
    ]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pages whose lines lie together; a page is held until the next one begins, across batches too."""
    page: list[Line] = []
    for batch in batches:
        done: list[tuple] = []
        for line in map(Line, *(batch.column(c).to_pylist() for c in Line._fields)):
            if page and (line.doc_id != page[0].doc_id or line.page != page[0].page):
                done += _page(page)
                page = []
            page.append(line)
        yield _block_rows(done)
    if page:
        yield _block_rows(_page(page))


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in BLOCK.split(", ")))
    columns = zip(*rows) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(columns, kinds)], list(names))


def blocks(lines: DataFrame) -> DataFrame:
    """Paragraphs of each page in reading order. Pages are dealt to tasks and come to Python sorted, many in a batch:
    most have few lines, and a call for each costs more than its work."""
    rows = lines.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), *Line._fields[2:])
    small_batches(lines.sparkSession)
    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page").mapInArrow(_pages, BLOCK)


def in_margin() -> Column:
    h = F.col("page_height")
    return (h > 0) & ((F.col("y1") <= h * MARGIN) | (F.col("y0") >= h - h * MARGIN))


def head_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), "[0-9]+", "#")


def with_running_heads(found: DataFrame) -> DataFrame:
    """Blocks with `running`: short ones in a margin that at least three pages and two fifths of a document's pages
    repeat. Counted in windows, so the blocks are made once."""
    keyed = found.withColumn("head", F.when(in_margin() & (F.length("text") <= HEAD_CHARACTERS), head_key(F.col("text"))))

    def pages(*keys: str) -> tuple[Column, Column]:
        at = F.when(F.col("page").isNotNull(), F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("page").asc_nulls_last())))
        return at, F.max("at").over(Window.partitionBy(*keys))

    for name, keys in (("pages", ["doc_id"]), ("hits", ["doc_id", "head"])):
        at, last = pages(*keys)
        keyed = keyed.withColumn("at", at).withColumn(name, last).drop("at")
    running = F.col("doc_id").isNotNull() & F.col("head").isNotNull() & (F.col("hits") >= HEAD_PAGES) & (F.col("hits") >= HEAD_SHARE * F.col("pages"))
    return keyed.select(*found.columns, F.coalesce(running, F.lit(False)).alias("running"))


def drop_running_heads(found: DataFrame) -> DataFrame:
    """Blocks less the running heads."""
    return with_running_heads(found).filter(~F.col("running")).drop("running")


def with_headings(found: DataFrame) -> DataFrame:
    """Blocks with title and level where they are headings: numbered, well known, or set larger than the body."""
    text, height = F.col("text"), (F.col("y1") - F.col("y0")) / F.greatest(F.col("line_count"), F.lit(1))
    body = found.groupBy("doc_id").agg(F.coalesce(F.percentile(F.when((F.length(text) >= HEAD_CHARACTERS) & (height > 0), height), F.lit(0.5)), F.lit(0.0)).alias("body"))
    can = (F.length(text) <= HEADING_CHARACTERS) & (F.col("line_count") <= HEADING_LINES) & ~text.rlike(r"[.,;:]$") & ~text.rlike(CAPTION)
    number, title = F.regexp_extract(text, NUMBERED, 1), F.trim(F.regexp_extract(text, NUMBERED, 2))
    plain = F.regexp_replace(F.lower(F.trim(text)), ":+$", "")
    heading = (
        F.when(can & (number != "") & ~title.rlike(r"^\p{Ll}"), F.struct(title.alias("title"), F.size(F.split(number, r"\.")).alias("level")))
        .when(can & plain.isin(HEADINGS), F.struct(F.trim(text).alias("title"), F.lit(1).alias("level")))
        .when(can & (F.col("body") > 0) & (height >= HEADING_HEIGHT * F.col("body")), F.struct(F.trim(text).alias("title"), F.lit(2).alias("level")))
    )
    return found.join(body, "doc_id").withColumn("heading", heading).drop("body")


def sections(found: DataFrame) -> DataFrame:
    """One row for each section: its heading, level, path of headings, first page and text; every block is in one."""
    so_far = Window.partitionBy("doc_id").orderBy("page", "place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = with_headings(found).withColumn("section", F.count("heading").over(so_far))
    above = F.collect_list("heading").over(so_far)  # as many as a document has headings
    path = F.aggregate(above, F.array().cast("array<string>"), lambda p, h: F.concat(F.slice(p, 1, h["level"] - 1), F.array(h["title"])))
    numbered = numbered.withColumn("path", F.when(F.col("heading").isNotNull(), path))
    rows = numbered.groupBy("doc_id", "section").agg(
        F.max("heading").alias("h"), F.max("path").alias("p"), F.min("page").alias("page"), F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("page", "place", "text"))).alias("t")
    )
    return rows.select("doc_id", "section", F.coalesce("h.title", F.lit("Document")).alias("heading"), F.coalesce("h.level", F.lit(0)).alias("level"), F.coalesce("p", F.array().cast("array<string>")).alias("heading_path"), "page", "blocks", F.array_join(F.col("t.text"), "\n").alias("text"))
