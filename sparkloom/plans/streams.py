"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.adapters import table
from sparkloom.plans.registry import query
from sparkloom.sources import files, sinks
from sparkloom.streaming import folder_view, jobs, ranking


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS began, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = jobs.windowed_counts(jobs.read_table(spark, f"{d}/events.parquet"), "1 hour", "event_type")
    done = jobs.run_to_table(counted, jobs.work_folder(spark), "complete")
    return done.select(F.unix_micros("w.start").alias("began"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(count(*) AS BIGINT) AS events, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS ended FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = jobs.sessions(jobs.read_table(spark, f"{d}/events.parquet"), "user_id", "6 hours")
    done = jobs.run_to_table(found, jobs.work_folder(spark), "complete")
    return done.select("user_id", "events", F.unix_micros("w.start").alias("began"), F.unix_micros("ended").alias("ended"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_receipts(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.read_table(spark, f"{d}/events.parquet").select("user_id", "event_type")
    return jobs.first_receipts_table(rows, jobs.work_folder(spark), "user_id", "event_type")


@query("SELECT user_id, max(epoch_us(ts)) AS us, arg_max(event_type, ts) AS state FROM events GROUP BY user_id")
def stream_last_states(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.read_table(spark, f"{d}/events.parquet").select("user_id", F.unix_micros("ts").alias("us"), F.col("event_type").alias("state"))
    return jobs.upsert_batches(rows, jobs.work_folder(spark), "user_id", "us").select("user_id", "us", "state")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def stream_cdc_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.read_table(spark, f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus")
    return jobs.upsert_batches(rows, jobs.work_folder(spark), "o_custkey", "o_orderkey")


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS n_links, regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS heading FROM pages""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.size(files.links(F.col("html"))).cast("long").alias("n_links"), files.heading(F.col("html")).alias("heading"))


@query()
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return files.html_sections(table(spark, d, "pages"), "page_id")


@query("""SELECT conv_id, turn, md5(to_json({'conv_id': conv_id, 'role': role, 'turn': turn})) AS digest FROM conversations""")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(sinks.canonical(c.select("conv_id", "turn", "role")).cast("binary")).alias("digest"))


@query("""SELECT source, lang, text_n, rank FROM (SELECT source, lang, CAST(count(*) AS BIGINT) AS text_n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source, lang) WHERE rank <= 3""")
def top_sources_per_language(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("text_n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("text_n"), "source")).cast("long")).filter("rank <= 3")


@query("""WITH l AS (SELECT user_id, arg_max(CAST(value AS DECIMAL(18, 6)), event_id) AS p, max(event_id) AS seq FROM events GROUP BY user_id)
SELECT 'c' || user_id AS candidate_key, CAST(p AS VARCHAR) AS probability, seq, row_number() OVER (ORDER BY p DESC, 'c' || user_id) AS rank FROM l""")
def stream_live_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Candidates ranked by their last score, from the state of a stream."""
    rows = jobs.read_table(spark, f"{d}/events.parquet")
    scores = rows.select(F.concat(F.lit("c"), "user_id").alias("candidate_key"), F.col("value").cast("decimal(18,6)").cast("string").alias("probability"), F.col("event_id").alias("position"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    folder = jobs.work_folder(spark)
    ranking.follow(scores, folder, shards=8)
    return ranking.ranked(ranking.complete(spark, folder)).select("candidate_key", "probability", "seq", "rank")


@query("""SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 8 = 5 THEN 1 ELSE 0 END AS cents, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 8 <> 3 GROUP BY ALL""")
def folder_projection(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files of lines, taken in; then one of eight folders goes and one is written anew with other prices."""
    work = jobs.work_folder(spark)
    source, out, schema = f"{work}/in", f"{work}/view", "k long, cents long"
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), (F.col("o_orderkey") % 8).alias("part"))
    rows.write.partitionBy("part").json(source)
    folder_view.refresh(spark, source, out, schema)
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/part=3")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    rows.filter("part = 5").select("k", (F.col("cents") + 1).alias("cents")).write.mode("overwrite").json(f"{source}/part=5")
    folder_view.refresh(spark, source, out, schema)
    return folder_view.view(spark, out, schema).groupBy("k", "cents").agg(F.count("*").alias("n"))
