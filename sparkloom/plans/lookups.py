"""Queries of lookups, set operations, windows and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.adapters import CANDIDATE, EVENT, ITEM, REQUEST, TRIAL, candidates, items, requests, table, trials, validation_events
from sparkloom.operators import ledger as L
from sparkloom.operators import lookups as K
from sparkloom.plans.registry import query


@query(f"WITH {EVENT}, l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ord DESC) AS r FROM validation) SELECT item_id, label, pass FROM l WHERE r = 1")
def latest_validation(spark: SparkSession, d: str) -> DataFrame:
    return K.latest(validation_events(spark, d), ["item_id"], F.desc("ord")).select("item_id", "label", "pass")


@query(f"WITH {EVENT} SELECT item_id, arg_max(label, ord) AS label, arg_max(pass, ord) AS pass FROM validation GROUP BY item_id")
def latest_validation_by_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return K.latest_value(validation_events(spark, d), ["item_id"], "ord").select("item_id", "label", "pass")


@query(f"""WITH {EVENT}, {CANDIDATE}, v AS (SELECT item_id, arg_max(label, ord) AS label FROM validation GROUP BY item_id),
j AS (SELECT c.sequence AS item_id, c.family, label FROM candidate c JOIN v ON v.item_id = c.sequence WHERE label = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY item_id DESC) AS r FROM j)
SELECT item_id, family, r = 1 AS kept FROM r""")
def last_writer_per_family(spark: SparkSession, d: str) -> DataFrame:
    v = K.latest_value(validation_events(spark, d), ["item_id"], "ord").filter("label = 1")
    j = candidates(spark, d).select(F.col("sequence").alias("item_id"), "family").join(v.select("item_id"), "item_id")
    last = j.groupBy("family").agg(F.max("item_id").alias("last"))
    return j.join(last, "family").select("item_id", "family", (F.col("item_id") == F.col("last")).alias("kept"))


@query(f"WITH {EVENT}, {CANDIDATE} SELECT sequence AS item_id FROM candidate WHERE type <> '' AND sequence NOT IN (SELECT item_id FROM validation)")
def pending_candidates(spark: SparkSession, d: str) -> DataFrame:
    return K.missing(candidates(spark, d).filter("type <> ''").select(F.col("sequence").alias("item_id")), validation_events(spark, d), "item_id")


@query(f"WITH {EVENT}, {CANDIDATE} SELECT family, CAST(count(*) AS BIGINT) AS n FROM candidate WHERE sequence IN (SELECT item_id FROM validation WHERE pass = 1) GROUP BY family")
def revisited_by_family(spark: SparkSession, d: str) -> DataFrame:
    again = validation_events(spark, d).filter("pass = 1").select(F.col("item_id").alias("sequence"))
    return candidates(spark, d).join(again, "sequence", "left_semi").groupBy("family").agg(F.count("*").alias("n"))


@query(f"""WITH {CANDIDATE}, o AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'reviewed' END AS venue, CASE WHEN toxic = 1 THEN 0 END AS year FROM labels)
SELECT sequence, coalesce(o.venue, candidate.venue) AS venue, coalesce(o.year, candidate.year, -1) AS year FROM candidate LEFT JOIN o ON o.doc_id = sequence""")
def metadata_overlay(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "labels").select(F.col("doc_id").alias("sequence"), F.when(F.col("quality") == 1, "reviewed").alias("venue"), F.when(F.col("toxic") == 1, 0).cast("long").alias("year"))
    done = K.overlay(candidates(spark, d).select("sequence", "venue", "year"), o, "sequence", ["venue", "year"])
    return done.withColumn("year", F.coalesce("year", F.lit(-1)))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_gate(spark: SparkSession, d: str) -> DataFrame:
    return K.duplicate_keys(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")), "l_orderkey", "l_linenumber")


@query("SELECT 0 AS violations")
def unique_request_gate(spark: SparkSession, d: str) -> DataFrame:
    return K.must_be_empty(K.duplicate_keys(table(spark, d, "orders"), "o_orderkey"), "request keys repeat")


@query(f"""WITH {REQUEST}, f AS (SELECT family, count(*) AS requests FROM request GROUP BY family)
SELECT coalesce(c.c_custkey, f.family) AS family, c.c_custkey IS NOT NULL AS known, CAST(coalesce(requests, 0) AS BIGINT) AS requests FROM customer c FULL JOIN f ON f.family = c.c_custkey""")
def family_trace_full_outer(spark: SparkSession, d: str) -> DataFrame:
    f = requests(spark, d).groupBy("family").agg(F.count("*").alias("requests"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("family"), F.lit(True).alias("known"))
    return c.join(f, "family", "full").select("family", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("requests", F.lit(0)).cast("long").alias("requests"))


@query("""SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE source = 'src3'""")
def union_of_semi_joins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").filter("quality = 1").select("doc_id").union(table(spark, d, "documents").filter("source = 'src3'").select("doc_id")).distinct()


@query(f"""WITH {CANDIDATE}, k AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY sequence) AS r, count(*) OVER (PARTITION BY md5(text)) AS copies FROM candidate)
SELECT sequence, CAST(copies AS BIGINT) AS copies FROM k WHERE r = 1""")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("sequence").alias("sequence"), F.count("*").alias("copies")).drop("h")


@query("""WITH b AS (SELECT doc_id AS id, source AS v FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id AS id, lang AS v FROM documents WHERE doc_id % 3 = 0)
SELECT * FROM b UNION ALL SELECT id, v FROM n WHERE id NOT IN (SELECT id FROM b)""")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return K.insert_or_ignore(docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("v")), docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("v")), "id", F.col("v"))


@query("""WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)""")
def state_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    part = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return K.same_rows(part("F"), part("O"))


@query(f"""WITH {CANDIDATE} SELECT sequence, list_sort(list_distinct(list_concat(origins, CASE WHEN sequence % 2 = 0 THEN ['refresh'] ELSE [] END)))[1] AS first_origin,
  CAST(len(list_distinct(list_concat(origins, CASE WHEN sequence % 2 = 0 THEN ['refresh'] ELSE [] END))) AS BIGINT) AS n FROM candidate""")
def provenance_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = candidates(spark, d).filter("sequence % 2 = 0").select("sequence", F.array(F.lit("refresh")).alias("more"))
    j = candidates(spark, d).join(new, "sequence", "left").withColumn("o", F.array_union("origins", F.coalesce("more", F.array().cast("array<string>"))))
    return j.select("sequence", F.array_sort("o")[0].alias("first_origin"), F.size("o").cast("long").alias("n"))


@query(f"WITH {ITEM} SELECT item_id, gold, string_agg(CAST(d_id AS VARCHAR), ',' ORDER BY rank) AS distractors FROM item GROUP BY item_id, gold")
def item_distractors(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("item_id", "gold", F.array_join(F.transform("distractors", lambda x: x["d_id"].cast("string")), ",").alias("distractors"))


@query("""SELECT b.item_id, c.condition, r.repeat, m.model, md5(b.item_id || '|' || c.condition || '|' || r.repeat || '|' || m.model) AS trial_id
FROM benchmark b, (SELECT unnest(['gold_present', 'gold_absent']) AS condition) c, (SELECT unnest(range(1, 4)) AS repeat) r, (SELECT unnest(['m0', 'm1', 'm2']) AS model) m""")
def planned_trials(spark: SparkSession, d: str) -> DataFrame:
    each = lambda *v: F.explode(F.array(*map(F.lit, v)))  # noqa: E731  a row per combination, no join
    t = table(spark, d, "benchmark").select("item_id", each("gold_present", "gold_absent").alias("condition")).select("*", each(1, 2, 3).alias("repeat")).select("*", each("m0", "m1", "m2").alias("model"))
    return t.select("item_id", "condition", F.col("repeat").cast("long").alias("repeat"), "model", F.md5(F.concat_ws("|", "item_id", "condition", "repeat", "model")).alias("trial_id"))


STATES = ("completed", "submitted", "ambiguous_charge")
STATE_SQL = ", ".join([f"CAST(count(*) FILTER (WHERE state = '{s}') AS BIGINT) AS {s}_n" for s in STATES] + [f"CAST(coalesce(sum(cost) FILTER (WHERE state = '{s}'), 0) AS DOUBLE) AS {s}_cost" for s in STATES])


@query(f"WITH {REQUEST} SELECT phase, stage, CAST(count(*) AS BIGINT) AS requests, {STATE_SQL} FROM request GROUP BY phase, stage")
def ledger_state_sums(spark: SparkSession, d: str) -> DataFrame:
    return L.state_sums(requests(spark, d), "phase", "stage")


@query(f"WITH {REQUEST} SELECT model, CAST(count(DISTINCT family) AS BIGINT) AS families, CAST(count(*) AS BIGINT) AS n FROM request WHERE phase = 'evaluation' GROUP BY ROLLUP (model)")
def evaluation_phase_rollup(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).filter("phase = 'evaluation'").rollup("model").agg(F.count_distinct("family").alias("families"), F.count("*").alias("n"))


@query(f"""WITH {REQUEST} SELECT family, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE state <> 'completed') AS BIGINT) AS open_calls, CAST(sum(cost) AS DOUBLE) AS cost,
  array_to_string(list_sort(list(DISTINCT run_id)), ',') AS runs, arg_max(stage, (submitted_at, request_key)) AS latest_stage FROM request GROUP BY family""")
def family_ledger(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).groupBy("family").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("state") != "completed").alias("open_calls"),
        F.sum("cost").cast("double").alias("cost"),
        F.array_join(F.array_sort(F.collect_set("run_id")), ",").alias("runs"),
        F.max_by("stage", F.struct("submitted_at", "request_key")).alias("latest_stage"),
    )


@query(f"WITH {REQUEST} SELECT run_id, CAST(sum(cost) FILTER (WHERE phase <> 'evaluation' AND state = 'completed' AND (run_id LIKE 'run1%' OR run_id LIKE 'run2%')) AS DOUBLE) AS cost, CAST(count(*) AS BIGINT) AS n FROM request GROUP BY run_id")
def construction_cost_by_run(spark: SparkSession, d: str) -> DataFrame:
    chosen = (F.col("phase") != "evaluation") & (F.col("state") == "completed") & F.exists(F.array(F.lit("run1"), F.lit("run2")), lambda p: F.startswith("run_id", p))
    return requests(spark, d).groupBy("run_id").agg(F.sum(F.when(chosen, F.col("cost"))).cast("double").alias("cost"), F.count("*").alias("n"))


@query(f"""WITH {REQUEST}, j AS (SELECT request_key AS seq, family AS k, CASE WHEN state = 'submitted' THEN NULL ELSE request_key END AS value FROM request WHERE request_key >= 100),
s AS (SELECT family AS k, max(request_key) AS value FROM request WHERE request_key < 100 GROUP BY family),
a AS (SELECT 99 AS seq, k, value FROM s UNION ALL SELECT * FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM a)
SELECT k, value FROM r WHERE r = 1 AND value IS NOT NULL""")
def snapshot_plus_journal(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    journal = r.filter("request_key >= 100").select(F.col("request_key").alias("seq"), F.col("family").alias("k"), F.when(F.col("state") != "submitted", F.col("request_key")).alias("value"))
    snapshot = r.filter("request_key < 100").groupBy(F.col("family").alias("k")).agg(F.max("request_key").alias("value"))
    return L.replay(snapshot, journal, "k", 99)


@query("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM events")
def trailing_hour_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("trailing"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS events, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS ended FROM s GROUP BY ALL""")
def burst_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = L.sessions(table(spark, d, "events"), ["user_id"], "ts", 21_600)
    return s.select("user_id", F.col("session").cast("long").alias("session"), "events", F.unix_micros(F.col("began").cast("timestamp")).alias("began"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"))


@query("""WITH l AS (SELECT user_id, lag(value) OVER w - value AS drop_, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, round(sum(drop_), 6) AS burned, CAST(count(*) AS BIGINT) AS pairs FROM l WHERE drop_ >= 0 AND us > 0 AND event_type <> 'purchase' GROUP BY user_id""")
def idle_baseline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("spend", F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    return L.idle_rate(e, ["user_id"], "ts", "value", "spend").select("user_id", "burned", "pairs")


@query(f"""WITH {TRIAL}, p AS (SELECT 'm' || i AS model, i + 1 AS price_in, 2 * i + 3 AS price_out FROM (SELECT unnest(range(0, 7)) AS i))
SELECT t.model, price_in IS NOT NULL AS priced, round(sum(coalesce(CAST(tokens * 1000 * price_in + tokens * 10 * price_out AS DOUBLE) / 1000000, 0)), 2) AS usd FROM trial t LEFT JOIN p ON p.model = t.model GROUP BY ALL""")
def list_price_equivalent(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.range(7).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"), (F.col("id") + 1).alias("price_in"), (2 * F.col("id") + 3).alias("price_out"))
    cost = L.token_cost(F.col("tokens") * 1000, F.col("tokens") * 10, F.col("price_in"), F.col("price_out"))
    t = trials(spark, d).join(F.broadcast(prices), "model", "left")  # seven rows
    return t.groupBy("model", F.col("price_in").isNotNull().alias("priced")).agg(F.round(F.sum(F.coalesce(cost, F.lit(0))).cast("double"), 2).alias("usd"))


@query(f"""WITH {TRIAL}, m AS (SELECT item_id, model, count(*) AS n FROM trial WHERE outcome <> 'N0' GROUP BY ALL), p AS (SELECT DISTINCT item_id FROM trial),
g AS (SELECT p.item_id, 'm' || i AS model FROM p, (SELECT unnest(range(0, 8)) AS i))
SELECT g.item_id, CAST(count(*) FILTER (WHERE coalesce(n, 0) < 8) AS BIGINT) AS open_models, coalesce(string_agg(g.model, ',' ORDER BY g.model) FILTER (WHERE coalesce(n, 0) < 8), '') AS models
FROM g LEFT JOIN m ON m.item_id = g.item_id AND m.model = g.model GROUP BY g.item_id""")
def open_models_by_item(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d)
    n = t.filter("outcome <> 'N0'").groupBy("item_id", "model").agg(F.count("*").alias("n"))
    plan = t.select("item_id").distinct().select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("m"), i.cast("string")))).alias("model"))
    short = F.coalesce("n", F.lit(0)) < 8
    got = plan.join(n, ["item_id", "model"], "left").groupBy("item_id").agg(F.count_if(short).alias("open_models"), F.array_sort(F.collect_list(F.when(short, F.col("model")))).alias("m"))
    return got.select("item_id", "open_models", F.array_join("m", ",").alias("models"))


@query("""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations)
SELECT coalesce(parent, 'none') AS parent, role, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL""")
def turn_lineage(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").withColumn("parent", F.coalesce(F.lag("role").over(w), F.lit("none"))).groupBy("parent", "role").agg(F.count("*").alias("n"))


def line_intervals(spark: SparkSession, d: str) -> DataFrame:
    """k, l_linenumber, low and high of each order line; quantities are rounded half to even, as SQL casts them."""
    low, quantity = F.col("l_linenumber") * 10, F.rint("l_quantity").cast("long")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("l_linenumber"), low.cast("long").alias("low"), (low + quantity).cast("long").alias("high"))


@query("""WITH i AS (SELECT l_orderkey AS k, l_linenumber * 10 AS low, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS high FROM lineitem),
b AS (SELECT *, max(high) OVER (PARTITION BY k ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM i),
n AS (SELECT *, sum(CASE WHEN before_ IS NULL OR low - before_ > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT k, CAST(island AS BIGINT) AS island, CAST(min(low) AS BIGINT) AS low, CAST(max(high) AS BIGINT) AS high FROM n GROUP BY k, island""")
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    return K.islands(line_intervals(spark, d), ["k"], "low", "high", 5).groupBy("k", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))


@query("""SELECT e.event_id, CAST(l.l_linenumber AS BIGINT) AS l_linenumber FROM events e JOIN lineitem l ON l.l_orderkey = e.user_id
WHERE floor(e.value * 10) >= l.l_linenumber * 10 AND floor(e.value * 10) < l.l_linenumber * 10 + CAST(l.l_quantity AS BIGINT)""")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), F.floor(F.col("value") * 10).alias("at"))
    return K.interval_join(p, line_intervals(spark, d), "k", "at", "low", "high", 64).select("event_id", "l_linenumber")


@query("""SELECT e.event_id, coalesce(o.o_orderkey, -1) AS o_orderkey FROM (SELECT event_id, user_id, ts - INTERVAL 26 YEAR AS at FROM events) e
ASOF LEFT JOIN (SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP) AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON o.o_custkey = e.user_id AND o.at <= e.at""")
def as_of_latest_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), (F.col("ts") - F.expr("INTERVAL 26 YEAR")).cast("timestamp").alias("at"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return K.as_of(e, o, "k", "at", "o_orderkey").select("event_id", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))
