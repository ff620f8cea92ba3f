"""Removal of repeated runs of lines, by content-defined chunks. DataFrame functions only.

A hash of each line and a rolling hash over the last two line hashes choose where a chunk ends: at the places where the
rolling hash is a local minimum, so equal runs of lines are cut alike wherever they stand, and a chunk has two lines or
more unless the text has but one. Of all chunks of two lines or more that are equal, the first (by doc_id, then text,
then place) stays and the others go, once their bytes have been compared with those of the one that stays. The first
pass shuffles only hashes (two of 64 bits for a chunk); texts move for chunks that repeat.

A hot chunk is counted in each task before any shuffle, and the join of its copies with its text is one whose sides are
dealt for the join alone, so that adaptive execution splits it. Very long texts and lines are cut whole; the work grows
with their chunks.

Null and empty texts stay as they are (a null has no lines). Rows that repeat a doc_id with another text are texts of
their own; of rows that repeat a doc_id and its text one keeps what a single row would keep and the others lose every
chunk of two lines or more. Rows without a doc_id pass through uncompared. Lines end at a line feed. Other columns pass
through, whatever their names; only columns named text, n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch


def with_chunks(docs: DataFrame) -> DataFrame:
    """docs (text) with lines, and ends: the last line of each chunk, counted from 1."""
    docs = docs.withColumn("lines", F.split("text", "\n", -1))
    docs = docs.withColumn("h", F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long")))
    last = F.size("lines")
    rolled = F.transform(F.sequence(F.lit(2), F.greatest(last, F.lit(2))), lambda i: F.pmod((F.get("h", i - 2) * 31 + F.get("h", i - 1)) * 40503, F.lit(1 << 32)))
    docs = docs.withColumn("r", rolled)

    def least(i: Column) -> Column:  # r begins at the second line
        return (i >= 2) & (i <= last - 2) & (F.get("r", i - 2) <= F.get("r", i - 1)) & ((i == 2) | (F.get("r", i - 2) < F.get("r", F.greatest(i - 3, F.lit(0)))))

    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | least(i))
    return docs.withColumn("ends", F.when(F.col("text").isNotNull(), ends)).drop("h", "r")


def chunk_start(j: Column) -> Column:
    """First line, counted from 1, of the chunk at place j."""
    return F.when(j == 0, F.lit(1)).otherwise(F.get("ends", j - 1) + 1)


def chunk_text(j: Column) -> Column:
    s = chunk_start(j)
    return F.array_join(F.slice("lines", s, F.get("ends", j) - s + 1), "\n")


def cut_rows(docs: DataFrame) -> DataFrame:
    """row (all columns of docs but text), text, n_lines and n_removed of each row of docs."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    every = docs.select("doc_id", "text", *[F.struct(*rest).alias("rest")] * bool(rest))
    row = F.struct(*[F.col("doc_id") if c == "doc_id" else F.col("rest")[c].alias(c) for c in docs.columns if c != "text"]).alias("row")
    others = [F.col("rest")[c] for c, kind in docs.dtypes if c in rest and "map<" not in kind]  # maps have no hash
    keyed = every.filter(F.col("doc_id").isNotNull()).withColumn("th", F.xxhash64("text"))

    places = F.filter(F.sequence(F.lit(0), F.size("ends") - 1), lambda j: F.get("ends", j) - chunk_start(j) >= 1)
    hashed = F.transform(places, lambda j: F.struct(j.alias("j"), F.xxhash64(chunk_text(j)).alias("h"), F.xxhash64(F.lit(1), chunk_text(j)).alias("g")))
    # explode_outer, as Spark would check before an explode that there are chunks, and cut the text once more for that
    found = with_chunks(keyed).select("doc_id", "th", F.explode_outer(hashed).alias("c")).filter(F.col("c").isNotNull()).select("doc_id", "th", "c.*")
    chunks = Scratch(found).read()  # read twice

    place = F.struct("doc_id", "th", "j")
    first = chunks.groupBy("h", "g").agg(F.count("*").alias("k"), F.min(place).alias("f")).filter("k > 1").select("h", "g", F.col("f.doc_id").alias("doc_id"), F.col("f.th").alias("fth"), F.col("f.j").alias("fj"))
    own = first.groupBy("doc_id").agg(F.collect_list(F.struct("h", "g", "fth", "fj")).alias("own"))  # as many as a document has chunks
    # both joins of the texts are by doc_id, so one shuffle of them serves both where there are no other columns
    kept = with_chunks(keyed.join(own, "doc_id").withColumn("own", F.filter("own", lambda o: o["fth"] == F.col("th"))))
    firsts = F.transform("own", lambda o: F.struct(o["h"].alias("h"), o["g"].alias("g"), o["fth"].alias("fth"), o["fj"].alias("fj"), chunk_text(o["fj"]).alias("kept")))
    kept = kept.select(F.col("doc_id").alias("fd"), F.explode_outer(firsts).alias("o")).filter(F.col("o").isNotNull()).select("fd", "o.*")
    # one row for each hash; grouped by more than the hash, so that the join deals both sides itself and can split them
    kept = kept.groupBy("h", "g", "fd", "fth", "fj").agg(F.first("kept").alias("kept"))

    met = chunks.join(kept, ["h", "g"]).filter((F.col("doc_id") != F.col("fd")) | (F.col("th") != F.col("fth")) | (F.col("j") != F.col("fj")))
    copies = met.groupBy("doc_id").agg(F.collect_list(F.struct("th", "j", "kept")).alias("copies"))

    out = with_chunks(keyed.join(copies, "doc_id", "left").withColumn("copies", F.filter("copies", lambda c: c["th"] == F.col("th"))))
    out = out.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.xxhash64(*others, "doc_id"))) > 1)
    same = F.filter("copies", lambda c: c["kept"] == chunk_text(c["j"]))
    gone = F.when(F.col("again") & F.col("text").isNotNull(), places).when(F.col("copies").isNotNull(), F.array_distinct(F.transform(same, lambda c: c["j"])))
    out = out.withColumn("gone", gone)
    left = F.array_except(F.sequence(F.lit(0), F.size("ends") - 1), F.col("gone"))
    text = F.when(F.size("gone") > 0, F.array_join(F.transform(left, chunk_text), "\n")).otherwise(F.col("text"))
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda a, j: a + F.get("ends", j) - chunk_start(j) + 1)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    # a row of its own for each document keeps filters of callers from being pushed into these expressions and computed with them
    result = F.struct(text.alias("text"), n_lines.alias("n_lines"), F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"))
    done = out.select(row, F.explode_outer(F.array(result)).alias("result")).select("row", "result.*")
    apart = every.filter(F.col("doc_id").isNull()).withColumn("lines", F.split("text", "\n", -1)).select(row, "text", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return done.unionByName(apart)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text less its repeated chunks, and n_lines and n_removed."""
    own = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut_rows(docs).select(*own, "n_lines", "n_removed")


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT doc_id, l, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM d WHERE text IS NOT NULL),
r AS (SELECT doc_id, l, list_transform(range(2, len(l) + 1), lambda i: ((h[i - 1] * 31 + h[i]) * 40503) % 4294967296) AS r FROM h),
e AS (
  SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: i = len(l)
    OR (i >= 2 AND i <= len(l) - 2 AND r[i - 1] <= r[i] AND (i = 2 OR r[i - 1] < r[i - 2]))) AS e FROM r),
c AS (
  SELECT doc_id, s.j AS j, array_to_string(l[(CASE WHEN s.j = 1 THEN 1 ELSE e[s.j - 1] + 1 END) : e[s.j]], chr(10)) AS t,
    e[s.j] - (CASE WHEN s.j = 1 THEN 0 ELSE e[s.j - 1] END) AS n
  FROM e, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS j) s),
o AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY t, n >= 2 ORDER BY doc_id, j) > 1 AS gone FROM c),
a AS (
  SELECT doc_id, string_agg(t, chr(10) ORDER BY j) FILTER (WHERE NOT gone) AS t,
    sum(n) AS n, coalesce(sum(n) FILTER (WHERE gone), 0) AS g FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(a.g, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(a.t, '') END) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""
