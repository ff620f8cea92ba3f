"""Queries of identifiers, texts, rule policies and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.adapters import CANDIDATE, ITEM, candidates, items, small_batches, table
from sparkloom.functions import ids as I
from sparkloom.functions import text as T
from sparkloom.operators import prefilter as P
from sparkloom.operators.lookups import positions
from sparkloom.plans.registry import query


@query("SELECT doc_id, 'source-' || substr(sha256(to_json([source, lang, CAST(doc_id AS VARCHAR)])), 1, 20) AS id FROM documents")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", I.stable_id("source", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


@query(f"""WITH {ITEM}, k AS (SELECT item_id, d_id, 'order-' || substr(sha256(to_json([CAST(item_id AS VARCHAR), CAST(d_id AS VARCHAR)])), 1, 20) AS k FROM item)
SELECT item_id, string_agg(CAST(d_id AS VARCHAR), ',' ORDER BY k) AS ordered FROM k GROUP BY item_id""")
def seeded_option_order(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d).select("item_id", F.transform("distractors", lambda x: x["d_id"].cast("string")).alias("v"))
    return i.select("item_id", F.array_join(I.seeded_order(F.col("v"), "order", F.col("item_id").cast("string")), ",").alias("ordered"))


@query(f"""WITH {ITEM}, c AS (SELECT unnest(['gold_present', 'gold_absent']) AS condition),
o AS (SELECT DISTINCT item_id, condition, 'gold' AS kind, gold AS text, 0 AS rank FROM item, c WHERE condition = 'gold_present'
  UNION ALL SELECT item_id, condition, 'distractor', d_text, rank FROM item, c WHERE condition = 'gold_absent' OR rank < 4 UNION ALL SELECT DISTINCT item_id, condition, 'abstain', 'None of these', 9 FROM item, c)
SELECT item_id, condition, CAST(count(*) AS BIGINT) AS options, string_agg(kind, ',' ORDER BY rank) AS kinds, md5(string_agg(text, '|' ORDER BY rank)) AS digest FROM o GROUP BY ALL""")
def condition_options(spark: SparkSession, d: str) -> DataFrame:
    """With the right answer the last distractor goes; both conditions end in an option to abstain."""
    i = items(spark, d)
    option = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    wrong = F.transform("distractors", lambda x: option("distractor", x["d_text"]))
    abstain = F.array(option("abstain", F.lit("None of these")))
    sets = F.array(
        F.struct(F.lit("gold_present").alias("condition"), F.concat(F.array(option("gold", F.col("gold"))), F.slice(wrong, 1, 3), abstain).alias("o")),
        F.struct(F.lit("gold_absent").alias("condition"), F.concat(wrong, abstain).alias("o")),
    )
    rows = i.select("item_id", F.explode(sets).alias("s")).select("item_id", "s.*")
    return rows.select("item_id", "condition", F.size("o").cast("long").alias("options"), F.array_join("o.kind", ",").alias("kinds"), F.md5(F.array_join("o.text", "|").cast("binary")).alias("digest"))


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 < 0.25")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(I.in_sample(F.col("doc_id").cast("string"), 0.25)).select("doc_id")


TYPE_SQL = "list_filter(list_transform(regexp_split_to_array(type, '[;,]'), lambda x: lower(trim(x))), lambda x: x <> '')"
RULE_SQL = f"""t AS (SELECT *, {TYPE_SQL} AS tokens FROM candidate),
c AS (SELECT *, CASE WHEN len(list_filter(origins, lambda o: starts_with(o, 'collaborator_seed:'))) > 0 THEN 'priority_seed' WHEN len(tokens) = 0 THEN 'unresolved_missing_type'
  WHEN len(list_filter(tokens, lambda x: x NOT IN {P.NONRESEARCH})) = 0 THEN 'flagged_nonresearch_type'
  WHEN list_has_any(tokens, {list(P.ARTICLE)}) AND list_has_any(tokens, {list(P.NONRESEARCH)}) THEN 'unresolved_mixed_type'
  WHEN list_has_any(tokens, {list(P.ARTICLE)}) THEN 'retained_article_type' ELSE 'unresolved_other_type' END AS disposition FROM t)"""
QUEUE_SQL = "CASE disposition " + " ".join(f"WHEN '{k}' THEN {P.QUEUES.index(v[1]) + 1}" for k, v in P.RULES.items()) + " END"
FLAG_SQL = (
    "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {n} IS NULL THEN 'missing_{n}' END" for n in ("doi", "stable_id", "year", "venue")) + ", CASE WHEN len(tokens) = 0 THEN 'missing_type' END, CASE WHEN landing_url IS NULL THEN 'missing_landing_url' END, CASE WHEN open_access_url IS NULL THEN 'missing_open_access_url' END], lambda x: x IS NOT NULL), ',')"
)


@query(f"WITH {CANDIDATE}, {RULE_SQL} SELECT candidate_key, disposition, CAST({QUEUE_SQL} AS BIGINT) AS queue_rank, {FLAG_SQL} AS flags FROM c")
def classify_metadata(spark: SparkSession, d: str) -> DataFrame:
    return P.classify(candidates(spark, d)).select("candidate_key", "disposition", F.col("queue_rank").cast("long").alias("queue_rank"), F.array_join("flags", ",").alias("flags"))


@query(f"WITH {CANDIDATE}, {RULE_SQL} SELECT disposition, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE doi IS NULL) AS BIGINT) AS without_doi FROM c GROUP BY disposition")
def disposition_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.classify(candidates(spark, d)).groupBy("disposition").agg(F.count("*").alias("n"), F.count_if(F.col("doi").isNull()).alias("without_doi"))


@query(f"WITH {CANDIDATE}, {RULE_SQL}, q AS (SELECT candidate_key, CAST({QUEUE_SQL} AS BIGINT) AS queue_rank, sequence FROM c) SELECT *, row_number() OVER (ORDER BY queue_rank, sequence) AS rank FROM q ORDER BY queue_rank, sequence LIMIT 100")
def review_queue_top(spark: SparkSession, d: str) -> DataFrame:
    c = P.classify(candidates(spark, d)).select("candidate_key", F.col("queue_rank").cast("long").alias("queue_rank"), "sequence")
    return P.ranked(c, [F.col("queue_rank"), F.col("sequence")], 100)


@query("""WITH b AS (SELECT doc_id, source, CASE WHEN length(text) >= 8000 THEN 'high' WHEN length(text) >= 2500 THEN 'medium' ELSE 'lower' END AS band FROM documents),
k AS (SELECT *, sha256('seed|' || source || '|' || doc_id) AS k, CASE band WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r FROM b)
SELECT doc_id, band, row_number() OVER (ORDER BY r, k) AS rank FROM k""")
def quality_order(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    band = F.when(n >= 8_000, "high").when(n >= 2_500, "medium").otherwise("lower")
    k = table(spark, d, "documents").select("doc_id", band.alias("band"), F.sha2(F.concat_ws("|", F.lit("seed"), "source", "doc_id"), 256).alias("k"))
    r = F.array_position(P.strings("high", "medium", "lower"), F.col("band"))
    return positions(k, F.struct(r.alias("r"), "k"), "rank").select("doc_id", "band", "rank")


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents WHERE text NOT LIKE '%ß%'")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(~F.contains("text", F.lit("ß"))).select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("digest"))


DOI_SQL = "CASE doc_id % 3 WHEN 0 THEN ' https://doi.org/10.1000/AB' || doc_id || '. ' WHEN 1 THEN 'doi:10.5/x' || doc_id ELSE 'no' || doc_id END"


@query(f"""WITH n AS (SELECT doc_id, regexp_replace(lower(trim({DOI_SQL})), '^(https://doi\\.org/|http://doi\\.org/|doi:)', '') AS doi FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(doi, '^10\\.[^\\s]*/[^\\s]*$') THEN regexp_replace(doi, '[. ]+$', '') ELSE 'invalid' END AS doi FROM n""")
def normalized_doi(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" https://doi.org/10.1000/AB"), i, F.lit(". "))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("doi:10.5/x"), i)).otherwise(F.concat(F.lit("no"), i))
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.normalize_doi(raw), F.lit("invalid")).alias("doi"))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(api[_-]?key|authorization|x-api-key|x-goog-api-key)(\\s*[:=]\\s*)([^\\s,}\\]]+)', '\\1\\2[REDACTED]', 'gi'),
  '(bearer)(\\s+)([^\\s,}\\]]+)', '\\1\\2[REDACTED]', 'gi'), '\\bsk-[A-Za-z0-9_-]{8,}\\b', '[REDACTED]', 'g'), '\\bAIza[A-Za-z0-9_-]{20,}\\b', '[REDACTED]', 'g')) AS digest FROM documents""")
def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("digest"))


@query("""WITH w AS (SELECT doc_id, length(text) AS characters, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS wide FROM documents)
SELECT doc_id, CAST(wide AS BIGINT) AS wide, CAST(floor((characters - wide) / 4.0 + wide / 1.5) AS BIGINT) AS tokens FROM w""")
def estimated_tokens(spark: SparkSession, d: str) -> DataFrame:
    wide = T.wide_characters(F.col("text"))
    return table(spark, d, "documents").select("doc_id", wide.cast("long").alias("wide"), T.estimated_tokens(F.length("text"), wide).alias("tokens"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 600) || chr(10) || right(text, 400) END) AS digest FROM documents")
def budgeted_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.budgeted(F.col("text"), 1_000), 256).alias("digest"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(l, lambda x: trim(x) = '')) AS BIGINT) AS blank,
  CAST(len(list_filter(l, lambda x: length(x) > 0 AND length(x) < 40)) AS BIGINT) AS short, CAST(len(list_filter(l, lambda x: regexp_matches(x, '[a-z]-$'))) AS BIGINT) AS broken FROM l""")
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in T.line_measures(F.col("text")).items()])


@query("""WITH s AS (SELECT doc_id, unnest(range(0, greatest(length(text) - 1, 0) + 1, 1000)) AS start, text FROM documents)
SELECT doc_id, CAST(start AS BIGINT) AS start, md5(substr(text, CAST(start + 1 AS INT), 1000)) AS digest FROM s""")
def fixed_segments(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.explode(T.segments(F.col("text"), 1_000)).alias("s"))
    return s.select("doc_id", F.col("s.start").cast("long").alias("start"), F.md5(F.col("s.piece").cast("binary")).alias("digest"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END) AS BIGINT) AS with_digits, round(avg(length(text)), 4) AS mean_length, median(length(text)) AS median_length FROM documents GROUP BY lang")
def corpus_quality(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("[0-9]")).alias("with_digits"), F.round(F.avg(n), 4).alias("mean_length"), F.median(n).alias("median_length"))


@query("""WITH m AS (SELECT doc_id, lower(substr(text, 1, 16000)) AS t FROM documents)
SELECT doc_id FROM m WHERE contains(t, 'the') AND (contains(t, 'tion') OR contains(t, 'ment'))""")
def marker_features(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower(F.substring("text", 1, 16_000))
    return table(spark, d, "documents").filter(F.contains(low, F.lit("the")) & (F.contains(low, F.lit("tion")) | F.contains(low, F.lit("ment")))).select("doc_id")


@query("""WITH l AS (SELECT user_id, list(CAST(value AS DOUBLE) - 40 ORDER BY event_id) AS lat FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN len(list_filter(lat, lambda x: x < -90 OR x > 90)) > 0 THEN 'invalid' WHEN list_max(lat) >= 20 AND list_min(lat) < 20 THEN 'mixed' WHEN list_max(lat) >= 20 THEN 'core' ELSE 'outside' END AS state FROM l""")
def geography_states(spark: SparkSession, d: str) -> DataFrame:
    lat = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.col("value") - 40).alias("lat"))
    return lat.select("user_id", P.geography(F.col("lat"), 20.0).alias("state"))


@query("""SELECT doc_id, title FROM (SELECT doc_id, substr(text, 1, 60) AS title, source, lang FROM documents) WHERE lower(title) LIKE '%the%' AND lang = 'en'
ORDER BY lower(title), doc_id LIMIT 25 OFFSET 25""")
def faceted_search_page(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), "lang")
    return t.filter(F.contains(F.lower("title"), F.lit("the")) & (F.col("lang") == "en")).orderBy(F.lower("title"), "doc_id").offset(25).limit(25).select("doc_id", "title")


@query()
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    small_batches(spark)
    c = table(spark, d, "documents").select("doc_id", "text", F.explode(T.chunker(cap=2_000, overlap=200)("text")).alias("c"))
    return c.select("doc_id", "c.start", "c.end", I.stable_id("chunk", F.col("doc_id").cast("string"), F.col("c.start").cast("string")).alias("chunk_id"))


@query()
def compatibility_normal_form(spark: SparkSession, d: str) -> DataFrame:
    small_batches(spark)
    return table(spark, d, "documents").select("doc_id", F.sha2(T.nfkc("text"), 256).alias("digest"))
