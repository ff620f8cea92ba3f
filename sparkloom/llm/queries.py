"""One query for each operator, over its whole table, and the SQL that gives the same where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontam, jaccard_join, lang_id, license_scan, line_dedup, packing, periodic_runs, quality_rules, secret_scan, substring_dedup, token_count, vptree, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents"), length=35)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=5, percent=80)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.repeat_some(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.digest(periodic_runs.detect(docs, min_length=6, min_exponent=4))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, k=8)
    return whitening.by_component(whitening.whiten(vectors, model), model)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_token_counts,
        op3_best_fit_packing,
        op4_decontamination,
        op5_secret_scan,
        op6_substring_dedup,
        op7_nearest_neighbours,
        op8_license_scan,
        op9_line_dedup,
        op10_ngram_jaccard_join,
        op11_periodic_runs,
        op12_embedding_whitening,
        op13_quality_rules,
    )
}

ORACLE = {
    "op9_line_dedup": line_dedup.ORACLE,
    "op6_substring_dedup": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s.i AS i, array_to_string(w[s.i : s.i + 34], ' ') AS k
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) s WHERE len(w) >= 35),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win WHERE k IN (SELECT k FROM rep)),
gone AS (
  SELECT DISTINCT doc_id, j.p AS p FROM hit, LATERAL (SELECT unnest(range(i, i + 35)) AS p) j),
word AS (SELECT doc_id, s.i AS i, w[s.i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) s),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.i WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op10_ngram_jaccard_join": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s.i : s.i + 4], ' ') AS k
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) s WHERE len(w) > 0),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id
  JOIN sz na ON na.doc_id = a.doc_id JOIN sz nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, coalesce(sz.n, 0) AS n_shingles, min(reach.y) AS component_id
FROM d LEFT JOIN sz ON sz.doc_id = d.doc_id JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, sz.n""",
    "op11_periodic_runs": r"""
WITH byte AS (
  SELECT doc_id, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS b,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (
  SELECT doc_id, w, len(w) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384::BIGINT * (xor(c, x) & 1)))) AS h FROM byte),
ap AS (
  SELECT doc_id, w, n, h, CASE WHEN n > 0 THEN (h // 10) % n END AS a,
    CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM h),
d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM ap),
word AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM d),
pair AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM word x JOIN word y
  ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair) GROUP BY doc_id, q, g
  HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (
  SELECT * FROM stretch a WHERE NOT EXISTS (
    SELECT 1 FROM stretch b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
runs AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t,
    list([s, l, q] ORDER BY -((l * 1000000000) // q), s, q)[1] AS best FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
left_over AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS t
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
  1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(runs.t, '')) AS runs_sha256, sha256(coalesce(left_over.t, '')) AS collapsed_sha256
FROM d LEFT JOIN runs ON runs.doc_id = d.doc_id LEFT JOIN left_over ON left_over.doc_id = d.doc_id""",
}
