"""A corpus pipeline of five operators: each stage takes (spark, docs, sf_dir) and returns what the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import decontam, jaccard_join, lang_id, line_dedup, packing
from sparkloom.llm.common import KEY, Scratch, with_text_keys
from sparkloom.llm.queries import table, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go, so null and letterless texts too."""
    return lang_id.keep_identified(docs, lang_id.fit(docs.filter(~lang_id.held_out())), min_score=0.4)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, and documents of which nothing is left. Null texts stay; so do rows without a doc_id,
    uncompared; of equal rows one keeps its lines. n_chars follows the text where lines went."""
    cut = line_dedup.cut_rows(docs).filter(F.col("text").isNull() | (F.col("n_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    changed = {"text": F.col("text"), "n_chars": n_chars}
    return cut.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the row with the smallest doc_id stays, once if rows repeat it with its text; several texts of one
    doc_id are rows of their own; rows without a doc_id stay."""
    keyed = with_text_keys(docs)
    near = jaccard_join.jaccard_components(keyed.filter("doc_id is not null").select(F.col(KEY).alias("doc_id"), "text"), k=5, percent=80)
    near = near.select(F.col("doc_id").alias("key"), "component_id").distinct()
    every = F.struct(*docs.columns).alias("row")
    known = keyed.filter("doc_id is not null").select("doc_id", KEY, every)
    ids = known.select("doc_id", F.col(KEY).alias("key")).distinct().join(near, "key")
    kept = ids.groupBy("component_id").agg(F.min_by("key", F.struct("doc_id", "key")).alias(KEY)).select(KEY)
    first = Window.partitionBy(KEY).orderBy(F.col("row.source"), F.col("row.lang"))
    known = known.join(kept, KEY, "left_semi").withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*")
    return known.unionByName(docs.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go; null and empty texts and rows without a doc_id stay. Items of fewer
    than five words are no passages here: they stand in clean texts too."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), min_words=5).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens; every row is packed, repeated ones too, null texts as empty ones."""
    return packing.pack(docs, vocabulary(), capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: Tokenising and edit distances have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage is written to the shared folder; the one before it goes once it is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        written = Scratch(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = written.read(), written
    return docs
