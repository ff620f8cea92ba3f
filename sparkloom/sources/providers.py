"""Bibliographic records of two providers, catalogues and XML articles as rows of one shape."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import ids as I
from sparkloom.functions.text import normalize_doi

WORK = (
    "DOI string, URL string, title array<string>, author array<struct<given:string,family:string,ORCID:string>>, published struct<`date-parts`:array<array<int>>>,"
    " license array<struct<URL:string>>, type string, subject array<string>, reference array<struct<DOI:string>>"
)
OPEN_WORK = (
    "id string, doi string, title string, authorships array<struct<author:struct<display_name:string,orcid:string>>>, publication_date string, publication_year int,"
    " primary_location struct<landing_page_url:string,license:string>, open_access struct<is_oa:boolean>"
)
RECORD = ("source_id", "stable_id", "doi", "title", "authors", "published_date", "year", "retrieval_url", "license", "discipline", "paper_family_id", "adapter", "reference_depth")


def record(rows: DataFrame, adapter: str, **columns: Column) -> DataFrame:
    """Records with ids that follow from DOI or stable id; rows without either or without a title are an error."""
    stable = F.coalesce(columns["doi"], columns["stable_id"])
    title = F.trim(columns["title"])
    fault = F.when(stable.isNull(), F.raise_error(F.lit("a record requires doi or stable_id"))).when(title.isNull() | (title == ""), F.raise_error(F.lit("a record requires a title")))
    given = {c: F.lit(None).cast("string") for c in ("published_date", "retrieval_url", "license", "discipline")} | {"year": F.lit(None).cast("int"), "authors": F.array().cast("array<string>")} | columns
    given |= {"stable_id": F.coalesce(fault.cast("string"), stable), "title": title, "source_id": I.stable_id("src", stable), "paper_family_id": I.stable_id("family", stable), "adapter": F.lit(adapter)}
    given.setdefault("reference_depth", F.lit(0))
    return rows.select(*[given[c].alias(c) for c in RECORD])


def parsed(messages: DataFrame, schema: str, message: str = "message") -> DataFrame:
    return messages.select(F.from_json(message, schema, {"mode": "FAILFAST"}).alias("m")).select("m.*")


def crossref_records(messages: DataFrame, message: str = "message") -> DataFrame:
    """Records of recorded works (JSON text)."""
    w = parsed(messages, WORK, message)
    parts = F.get(F.col("published.date-parts"), F.lit(0))
    date = F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: F.lpad(p.cast("string"), F.greatest(F.lit(2), F.length(p.cast("string"))), F.lit("0"))), "-"))
    name = lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))
    return record(
        w, "crossref", doi=normalize_doi(F.col("DOI")), stable_id=F.col("URL"), title=F.coalesce(F.get("title", F.lit(0)), F.lit("Untitled")), authors=F.coalesce(F.transform("author", name), F.array().cast("array<string>")),
        published_date=date, year=F.get(parts, F.lit(0)), retrieval_url=F.col("URL"), license=F.get("license", F.lit(0))["URL"], discipline=F.get("subject", F.lit(0)),
    )


def openalex_records(messages: DataFrame, message: str = "message") -> DataFrame:
    w = parsed(messages, OPEN_WORK, message)
    return record(
        w, "openalex", doi=normalize_doi(F.col("doi")), stable_id=F.col("id"), title=F.coalesce("title", F.lit("Untitled")), authors=F.coalesce(F.transform("authorships", lambda a: a["author"]["display_name"]), F.array().cast("array<string>")),
        published_date=F.col("publication_date"), year=F.col("publication_year"), retrieval_url=F.coalesce("primary_location.landing_page_url", "doi", "id"), license=F.col("primary_location.license"),
    )


def reference_expansion(messages: DataFrame, limit: int, message: str = "message") -> DataFrame:
    """Parents and, one level down, the first `limit` referenced works of each that are among the messages."""
    w = messages.select(message, F.from_json(message, WORK).alias("m"))
    doi = w.select(normalize_doi(F.col("m.DOI")).alias("doi"), message).filter("doi is not null").dropDuplicates(["doi"])
    cited = w.select(normalize_doi(F.col("m.DOI")).alias("parent_doi"), F.posexplode("m.reference").alias("place", "r")).filter("parent_doi is not null")
    known = cited.withColumn("doi", normalize_doi(F.col("r.DOI"))).filter("doi is not null").join(doi, "doi")
    first = Window.partitionBy("parent_doi").orderBy("place")
    children = known.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit)
    found = crossref_records(children.select(message).distinct(), message).withColumn("reference_depth", F.lit(1))
    return children.select("parent_doi", "n", "doi").join(found, "doi").select("parent_doi", F.col("n").cast("long").alias("place"), *[c for c in RECORD])


def public_catalog(rows: DataFrame) -> DataFrame:
    """Records of a catalogue table; private rows and those without id or title stay out."""
    stable = F.coalesce(F.nullif("inventory_id", F.lit("")), "item_key")
    public = rows.filter(~F.coalesce(F.lower("private").isin("1", "true", "yes"), F.lit(False)) & stable.isNotNull() & (stable != "") & (F.trim("title") != ""))
    return record(public, "catalog", doi=F.lit(None).cast("string"), stable_id=stable, title=F.col("title"), retrieval_url=F.col("source_url"), license=F.col("availability"))


# Elements of an article that hold sections.
SECTION_TAGS = ("sec", "abstract", "body", "p")


def article_sections(raw: str) -> list[tuple[str, int, str]]:
    """(heading, level, text) of the sections of an XML article, outer ones before inner ones."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    flat = lambda e: " ".join(" ".join(e.itertext()).split())
    root, out = ET.fromstring(raw), []
    for e in root.iter():
        if local(e) in SECTION_TAGS and (text := flat(e)):
            title = next((" ".join(c.itertext()) for c in e if local(c) == "title"), local(e))
            out.append((title, 2 if local(e) == "p" else 1, text))
    return out or [("Document", 0, flat(root))]


def xml_sections(articles: DataFrame, key: str, raw: str = "xml") -> DataFrame:
    """key, place, heading, level and text of each section; XML that can't be read is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, *s) for k, x in zip(f[key], f[raw]) if x for i, s in enumerate(article_sections(x))]
            yield pd.DataFrame(rows, columns=[key, "place", "heading", "level", "text"])

    return articles.select(key, raw).mapInPandas(run, f"{key} {dict(articles.dtypes)[key]}, place int, heading string, level int, text string")
