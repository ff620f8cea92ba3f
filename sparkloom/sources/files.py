"""Scans of line and table files with fixed schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException


def jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = False, absent_is_empty: bool = False) -> DataFrame:
    """JSON lines, blank ones skipped; strict: a line that is no object is an error."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    except AnalysisException:
        if absent_is_empty:
            return spark.createDataFrame([], schema)
        raise


def json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def partitioned_jsonl(spark: SparkSession, pattern: str, schema: StructType, part: str, regex: str) -> DataFrame:
    """JSON lines in a tree, with a column that their path tells."""
    return spark.read.schema(schema).json(pattern).withColumn(part, F.regexp_extract(F.col("_metadata.file_path"), regex, 1))


def tsv(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> DataFrame:
    """Tab-separated rows that have all required columns."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    for c in required:
        rows = rows.filter(F.col(c).isNotNull() & (F.trim(c) != ""))
    return rows


def normalized_pages(pages: DataFrame, *shapes: str) -> DataFrame:
    """Records of recorded result pages, whichever of several fields holds them."""
    return pages.select(F.explode(F.coalesce(*shapes)).alias("record")).select("record.*")


def journal(spark: SparkSession, path: str, schema: StructType, only_torn_tail: bool = False) -> DataFrame:
    """An append-only journal of JSON objects with the order of its lines (ord: file, block of it, line); blank lines
    and lines that are no object are dropped. only_torn_tail: such a line that isn't the last of its file is an error."""
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", block.alias("ord")).filter(F.trim("value") != "")
    kept = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    rows = lines.select("ord", "value", F.from_json("value", kept).alias("row"))
    good = F.col("row._corrupt_record").isNull() & F.col("value").rlike(r"^\s*\{")
    if only_torn_tail:
        last = rows.groupBy(F.col("ord.file").alias("file")).agg(F.max("ord").alias("last"))  # a row for each file
        rows = rows.join(F.broadcast(last), F.col("ord.file") == F.col("file"))
        good = good | F.when(F.col("ord") != F.col("last"), F.raise_error(F.concat(F.lit("a line of the journal is broken: "), "ord.file")).cast("boolean"))
        good = F.coalesce(good, F.lit(False))
    return rows.filter(good).select("row.*", "ord").drop("_corrupt_record")


def links(html: Column) -> Column:
    """Targets of anchors, whatever their other attributes and their quotes."""
    return F.regexp_extract_all(html, F.lit("""(?is)<a\\b(?:[^>"']|"[^"]*"|'[^']*')*?\\bhref\\s*=\\s*["']([^"']*)["']"""), 1)


def heading(html: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")


class _Sections(HTMLParser):
    SKIPPED = frozenset({"script", "style", "nav"})
    BLOCKS = frozenset({"p", "li", "div", "td", "figcaption", "br"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[list] = [["", []]]
        self.skipping, self.in_heading = 0, False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.SKIPPED:
            self.skipping += 1
        elif tag in ("h1", "h2", "h3", "h4"):
            self.sections.append(["", []])
            self.in_heading = True
        elif tag in self.BLOCKS:
            self.sections[-1][1].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag in ("h1", "h2", "h3", "h4"):
            self.in_heading = False

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.in_heading:
            self.sections[-1][0] += data
        else:
            self.sections[-1][1].append(data)


def sections_of(html: str) -> Iterator[tuple[int, str, str]]:
    """(number, heading, text) of the parts of a page that headings begin."""
    parser = _Sections()
    parser.feed(html or "")
    n = 0
    for title, parts in parser.sections:
        text = "\n".join(x for line in "".join(parts).split("\n") if (x := " ".join(line.split())))
        if title.strip() or text:
            yield n, " ".join(title.split()), text
            n += 1


def html_sections(pages: DataFrame, key: str) -> DataFrame:
    """One row per section of each page."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(k, *s) for k, h in zip(f[key], f["html"]) for s in sections_of(h)]
            yield pd.DataFrame(rows, columns=[key, "section", "heading", "text"])

    return pages.select(key, "html").mapInPandas(run, f"{key} long, section int, heading string, text string")
