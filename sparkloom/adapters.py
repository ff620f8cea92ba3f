"""Relations of the evaluation domain, derived from the tables at hand by deterministic expressions.

Each relation also exists as a SQL common table expression with equal rows, for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 4_000_000) -> None:
    """Sends rows to Python in batches of this many bytes, or of one longer row. A caller's own setting stays."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(size))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of models to items, with and without the right answer among the options."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    present = F.col("event_id") % 2 == 0
    outcome = (
        F.when(F.col("event_type") == "error", "N0")
        .when(present, F.when(F.col("event_type") == "click", "N1").when(F.col("event_type") == "view", "N2").otherwise("N3"))
        .otherwise(F.when(F.col("event_type").isin("click", "view"), "N4").otherwise("N5"))
    )
    return e.select(
        F.col("event_id").alias("trial_id"),
        F.col("user_id").alias("item_id"),
        F.concat(F.lit("m"), (F.col("k") % 8).cast("string")).alias("model"),
        F.when(F.col("k") % 3 == 0, "b").otherwise("a").alias("arm"),
        F.when(present, "gold_present").otherwise("gold_absent").alias("condition"),
        (1 + F.floor(F.col("event_id") / 2) % 3).cast("long").alias("repeat"),
        outcome.alias("outcome"),
        F.substring(F.lit("ABCDE"), (1 + F.col("k") % 5).cast("int"), 1).alias("letter"),
        F.when(F.col("event_type") == "error", F.when(F.col("k") % 3 == 0, "empty_response").when(F.col("k") % 3 == 1, "not_a_letter").otherwise("finish_reason")).alias("invalid_reason"),
        F.col("value").cast("decimal(18,6)").alias("cost_usd"),
        F.col("k").alias("tokens"),
        "ts",
    )


TRIAL = """trial AS (
  SELECT event_id AS trial_id, user_id AS item_id, 'm' || (k % 8) AS model, CASE WHEN k % 3 = 0 THEN 'b' ELSE 'a' END AS arm,
    CASE WHEN event_id % 2 = 0 THEN 'gold_present' ELSE 'gold_absent' END AS condition, 1 + (event_id // 2) % 3 AS repeat,
    CASE WHEN event_type = 'error' THEN 'N0'
      WHEN event_id % 2 = 0 THEN CASE event_type WHEN 'click' THEN 'N1' WHEN 'view' THEN 'N2' ELSE 'N3' END
      WHEN event_type IN ('click', 'view') THEN 'N4' ELSE 'N5' END AS outcome,
    substr('ABCDE', CAST(1 + k % 5 AS INT), 1) AS letter,
    CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'empty_response' WHEN 1 THEN 'not_a_letter' ELSE 'finish_reason' END END AS invalid_reason,
    CAST(value AS DECIMAL(18,6)) AS cost_usd, k AS tokens, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of requests with states and costs."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_key"),
        F.col("o_custkey").alias("family"),
        F.col("o_orderpriority").alias("stage"),
        F.when(F.col("o_orderkey") % 2 == 0, "generation").otherwise("evaluation").alias("phase"),
        F.concat(F.lit("run"), (F.col("o_orderkey") % 4).cast("string")).alias("run_id"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 8).cast("string")).alias("model"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "submitted").otherwise("ambiguous_charge").alias("state"),
        F.col("o_totalprice").cast("decimal(18,6)").alias("cost"),
        F.col("o_orderdate").cast("timestamp").alias("submitted_at"),
    )


REQUEST = """request AS (
  SELECT o_orderkey AS request_key, o_custkey AS family, o_orderpriority AS stage,
    CASE WHEN o_orderkey % 2 = 0 THEN 'generation' ELSE 'evaluation' END AS phase, 'run' || (o_orderkey % 4) AS run_id,
    'm' || (o_custkey % 8) AS model,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'submitted' ELSE 'ambiguous_charge' END AS state,
    CAST(o_totalprice AS DECIMAL(18,6)) AS cost, CAST(o_orderdate AS TIMESTAMP) AS submitted_at FROM orders)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers found by a search, with the gaps that provider metadata has."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    types = F.when(i % 6 == 0, "JournalArticle").when(i % 6 == 1, "Review").when(i % 6 == 2, "JournalArticle; Review").when(i % 6 == 3, "Conference").when(i % 6 == 4, F.lit("")).otherwise("Editorial,News")
    return d.select(
        F.concat(F.lit("10.1000/"), i.cast("string")).alias("candidate_key"),
        i.alias("sequence"),
        F.col("source").alias("family"),
        F.substring("text", 1, 80).alias("title"),
        types.alias("type"),
        F.when(i % 11 == 0, F.array(F.lit("collaborator_seed:one"), F.lit("search:q1"))).otherwise(F.array(F.lit("search:q1"))).alias("origins"),
        F.when(i % 3 != 0, F.concat(F.lit("10.1000/"), i.cast("string"))).alias("doi"),
        F.when(i % 5 != 0, F.concat(F.lit("s2:"), i.cast("string"))).alias("stable_id"),
        F.when(i % 4 != 0, (F.lit(1990) + i % 30)).cast("long").alias("year"),
        F.when(i % 7 != 0, F.col("source")).alias("venue"),
        F.when(i % 2 == 0, F.concat(F.lit("https://example.org/"), i.cast("string"))).alias("landing_url"),
        F.when(i % 13 == 0, F.concat(F.lit("https://example.org/oa/"), i.cast("string"))).alias("open_access_url"),
        "text",
        "lang",
    )


CANDIDATE = """candidate AS (
  SELECT '10.1000/' || doc_id AS candidate_key, doc_id AS sequence, source AS family, substr(text, 1, 80) AS title,
    CASE doc_id % 6 WHEN 0 THEN 'JournalArticle' WHEN 1 THEN 'Review' WHEN 2 THEN 'JournalArticle; Review' WHEN 3 THEN 'Conference'
      WHEN 4 THEN '' ELSE 'Editorial,News' END AS type,
    CASE WHEN doc_id % 11 = 0 THEN ['collaborator_seed:one', 'search:q1'] ELSE ['search:q1'] END AS origins,
    CASE WHEN doc_id % 3 <> 0 THEN '10.1000/' || doc_id END AS doi, CASE WHEN doc_id % 5 <> 0 THEN 's2:' || doc_id END AS stable_id,
    CASE WHEN doc_id % 4 <> 0 THEN 1990 + doc_id % 30 END AS year, CASE WHEN doc_id % 7 <> 0 THEN source END AS venue,
    CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || doc_id END AS landing_url,
    CASE WHEN doc_id % 13 = 0 THEN 'https://example.org/oa/' || doc_id END AS open_access_url, text, lang FROM documents)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: each benchmark text is a right answer; the next four, cyclically, are its distractors."""
    b = table(spark, sf_dir, "benchmark")
    n = b.agg(F.count("*").alias("n"))
    b = b.crossJoin(F.broadcast(n)).select("item_id", "text", "n")  # one row
    steps = b.select("item_id", "text", "n", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank"))
    d = b.select(F.col("item_id").alias("d_id"), F.col("text").alias("d_text"))
    joined = steps.withColumn("d_id", (F.col("item_id") + F.col("rank")) % F.col("n")).join(d, "d_id")
    return joined.groupBy("item_id").agg(F.first("text").alias("gold"), F.first("text").alias("question"), F.array_sort(F.collect_list(F.struct("rank", "d_id", "d_text"))).alias("distractors"))


ITEM = """item AS (
  SELECT b.item_id, b.text AS gold, b.text AS question, s.rank AS rank, d.item_id AS d_id, d.text AS d_text
  FROM benchmark b, (SELECT unnest(range(1, 5)) AS rank) s, benchmark d
  WHERE d.item_id = (b.item_id + s.rank) % (SELECT count(*) FROM benchmark))"""


def validation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on candidates, a later pass over every third one included; ord is the order of arrival."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("label"), F.lit(0).alias("pass"))
    again = labels.filter("doc_id % 3 = 0").select("doc_id", (1 - F.col("label")).alias("label"), F.lit(1).alias("pass"))
    return labels.union(again).select(F.col("doc_id").alias("item_id"), "label", F.col("pass").cast("long").alias("pass"), (F.col("doc_id") * 2 + F.col("pass")).cast("long").alias("ord"))


EVENT = """validation AS (
  SELECT doc_id AS item_id, CAST(quality AS BIGINT) AS label, CAST(0 AS BIGINT) AS pass, doc_id * 2 AS ord FROM labels
  UNION ALL SELECT doc_id, CAST(1 - quality AS BIGINT), CAST(1 AS BIGINT), doc_id * 2 + 1 FROM labels WHERE doc_id % 3 = 0)"""
