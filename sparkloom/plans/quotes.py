"""Queries that bind quotes to texts and find the sentences that spell out acronyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.adapters import small_batches, table
from sparkloom.functions import text as T
from sparkloom.operators import quotes as Q
from sparkloom.operators import spans as S
from sparkloom.plans.registry import query

#: Quotes: the third to eleventh word of an item, whole and with other white space; a word alone; one that is nowhere;
#: one with another hash.
SQL_QUOTES = """w AS (SELECT item_id, regexp_extract_all(text, '[^ \\t\\n\\r\\v\\f]+') AS w FROM benchmark),
quote AS (
  SELECT item_id * 5 AS quote_id, array_to_string(w[3:11], ' ') AS quote FROM w
  UNION ALL SELECT item_id * 5 + 1, array_to_string(w[3:11], chr(10)) FROM w
  UNION ALL SELECT item_id * 5 + 2, w[4] || ' ' || w[5] FROM w
  UNION ALL SELECT item_id * 5 + 3, array_to_string(w[3:9], ' ') || ' nowhere at all' FROM w
  UNION ALL SELECT item_id * 5 + 4, CASE item_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'changed' END FROM w)"""


def quotes(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select("item_id", Q.words(F.col("text")).alias("w"))
    part = lambda a, n: F.slice("w", a, n)
    kinds = [F.array_join(part(3, 9), " "), F.array_join(part(3, 9), "\n"), F.array_join(part(4, 2), " "), F.concat(F.array_join(part(3, 7), " "), F.lit(" nowhere at all")), F.when(F.col("item_id") % 3 == 0, " ").when(F.col("item_id") % 3 == 1, "changed")]
    rows = w.select("item_id", F.posexplode(F.array(*kinds)).alias("kind", "quote"))
    changed = F.when(F.col("quote") == "changed", F.sha2(F.lit("other"), 256)).otherwise(F.sha2("quote", 256))
    return rows.select((F.col("item_id") * 5 + F.col("kind")).alias("quote_id"), "quote", changed.alias("quote_sha256"))


@query(f"""WITH {SQL_QUOTES}, asked AS (SELECT DISTINCT quote FROM quote WHERE trim(quote, ' ') <> '' AND quote <> 'changed'),
flat AS (SELECT doc_id, text, regexp_replace(text, '\\s+', ' ', 'g') AS flat FROM documents),
pattern AS (SELECT quote, '(' || array_to_string(list_transform(regexp_extract_all(quote, '[^ \\t\\n\\r\\v\\f]+'), lambda x: regexp_replace(x, '([^\\p{{L}}\\p{{N}}_])', '\\\\\\1', 'g')), '\\s+') || ')' AS p,
  regexp_matches(quote, '^[\\p{{L}}\\p{{N}}_]') AS opens, regexp_matches(quote, '[\\p{{L}}\\p{{N}}_]$') AS closes FROM asked),
loose AS (SELECT *, CASE WHEN opens THEN '(?:^|[^\\p{{L}}\\p{{N}}_])' ELSE '' END || p || CASE WHEN closes THEN '(?:$|[^\\p{{L}}\\p{{N}}_])' ELSE '' END AS r FROM pattern),
hit AS (SELECT l.quote, d.doc_id, strpos(d.text, l.quote) AS e, CASE WHEN NOT contains(d.text, l.quote) THEN regexp_extract(d.text, r, 1) END AS loose
  FROM loose l JOIN flat d ON contains(d.flat, regexp_replace(l.quote, '\\s+', ' ', 'g')) AND CASE WHEN contains(d.text, l.quote) THEN true WHEN contains(d.flat, regexp_replace(l.quote, '\\s+', ' ', 'g')) THEN regexp_matches(d.text, r) ELSE false END),
first AS (SELECT quote, min(doc_id) AS doc_id FROM hit GROUP BY quote),
spot AS (SELECT f.quote, f.doc_id, CASE WHEN h.e > 0 THEN h.e - 1 ELSE strpos(d.text, h.loose) - 1 END AS s, CASE WHEN h.e > 0 THEN h.quote ELSE h.loose END AS t, CASE WHEN h.e > 0 THEN 'exact' ELSE 'whitespace_equivalent' END AS kind
  FROM first f JOIN hit h ON h.quote = f.quote AND h.doc_id = f.doc_id JOIN documents d ON d.doc_id = f.doc_id)
SELECT quote_id, CASE WHEN q.quote IS NULL OR q.quote = 'changed' THEN 'invalid' WHEN trim(q.quote, ' ') = '' THEN 'blank' WHEN a.quote IS NULL THEN 'unbound' ELSE 'located' END AS status,
  coalesce(a.doc_id, -1) AS chunk_id, CAST(coalesce(s, -1) AS BIGINT) AS start_offset, CAST(coalesce(s + length(t), -1) AS BIGINT) AS end_offset, sha256(t) AS text_sha256, kind AS match_kind FROM quote q LEFT JOIN spot a ON a.quote = q.quote""")
def located_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of benchmark items in the documents: the first that holds each, and where (-1: nowhere)."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("place"), "text")
    found = Q.locate(quotes(spark, d), chunks).drop("text")
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("chunk_id", "start_offset", "end_offset")})


#: Documents that open with a gloss of their own words: the letters of the first three, or of the first and third.
SQL_LETTERS = "upper(w[1][1]) || CASE WHEN doc_id % 2 = 0 THEN upper(w[2][1]) ELSE '' END || upper(w[3][1])"
OPENING = r"(?s)^((?:[^A-Za-z]*[A-Za-z]+){0,3})"


@query(f"""WITH o AS (SELECT doc_id, source, regexp_extract_all(text, '[A-Za-z]+')[1:3] AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, source, {SQL_LETTERS} AS token, array_to_string(w, ' ') AS words FROM o WHERE len(w) = 3),
own AS (SELECT *, list_filter(string_split(lower(words), ' '), lambda x: x NOT IN ({", ".join(f"'{x}'" for x in Q.GLUE_WORDS)})) AS c FROM g WHERE length('so ' || words || ' (' || token || ') rose') >= {Q.LEAST_SENTENCE}),
firsts AS (SELECT doc_id, source, token, words, CASE WHEN len(c) > 0 THEN array_to_string(list_transform(list_prepend('so', c), lambda x: x[1]), '') ELSE 's' END AS i FROM own),
good AS (SELECT * FROM firsts WHERE ends_with(i, lower(token)) OR (length(i) > 1 AND contains(right(i[1:length(i) - 1], length(token) + 1), lower(token)[1]))),
first AS (SELECT source, token, min(doc_id) AS doc_id FROM good GROUP BY source, token)
SELECT g.doc_id AS display_id, g.token AS token, f.doc_id AS chunk_id, CAST(0 AS BIGINT) AS start, 'So ' || x.words || ' (' || g.token || ') rose.' AS sentence
FROM g JOIN first f ON f.source = g.source AND f.token = g.token JOIN g x ON x.doc_id = f.doc_id""")
def gloss_sentences(spark: SparkSession, d: str) -> DataFrame:
    """For the acronym of each document the first sentence of its source that spells it out."""
    w = F.regexp_extract_all(F.regexp_extract("text", OPENING, 1), F.lit("([A-Za-z]+)"), 1)
    rows = table(spark, d, "documents").select("doc_id", "source", w.alias("w"), "text").filter("size(w) = 3")
    first = lambda k: F.upper(F.substring(F.get("w", F.lit(k)), 1, 1))
    token = F.concat(first(0), F.when(F.col("doc_id") % 2 == 0, first(1)).otherwise(""), first(2))
    text = F.concat(F.lit("So "), F.array_join("w", " "), F.lit(" ("), token, F.lit(") rose.\n\n"), F.replace("text", F.lit("("), F.lit("")))
    rows = rows.select("doc_id", "source", token.alias("token"), text.alias("text"))
    chunks = rows.select("source", F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("place"), "text")
    displays = rows.select(F.col("doc_id").alias("display_id"), "source", F.array("token").alias("tokens"))
    return Q.definitions(displays, chunks, ["source"]).select("display_id", "token", "chunk_id", "start", "sentence")


@query()
def span_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of at most 2,000 bytes of each document: their spans, places and hashes."""
    spans_ = S.byte_blocks(table(spark, d, "documents"), "doc_id", "text", 2_000)
    # spans of a block lie together, but a doc_id may repeat: the hash tells its texts apart
    return spans_.groupBy("doc_id", "block", "block_sha256").agg(F.count("*").alias("spans"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"))


@query()
def combined_spans(spark: SparkSession, d: str) -> DataFrame:
    """Two of three sentences of each document, those next to each other taken together."""
    small_batches(spark)
    docs = table(spark, d, "documents").filter("doc_id is not null and text is not null")
    rows = docs.select(F.col("doc_id").alias("chunk_id"), F.posexplode(T.sentences("text")).alias("i", "s")).filter("i % 3 <> 0")
    chosen = rows.select("chunk_id", F.col("i").alias("span_id"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    found = S.coalesced(chosen, docs.select(F.col("doc_id").alias("chunk_id"), "text"))
    return found.select(F.col("chunk_id").cast("long").alias("chunk_id"), "start_offset", "end_offset", F.size("source_span_ids").cast("long").alias("spans"), "text_sha256")
