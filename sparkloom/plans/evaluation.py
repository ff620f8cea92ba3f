"""Queries that plan, render, parse and schedule evaluation trials, and read nested reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.adapters import ITEM, REQUEST, TRIAL, items, requests, table, trials
from sparkloom.functions import ids as I
from sparkloom.functions import validation as V
from sparkloom.operators.lookups import positions
from sparkloom.operators.prefilter import strings
from sparkloom.plans.registry import query

RAW_SQL = "CASE event_id % 7 WHEN 0 THEN ' A ' WHEN 1 THEN 'B' WHEN 2 THEN 'b' WHEN 3 THEN 'AB' WHEN 4 THEN '' WHEN 5 THEN 'Z' ELSE NULL END"


def raw_answer() -> Column:
    return F.element_at(F.array(F.lit(" A "), F.lit("B"), F.lit("b"), F.lit("AB"), F.lit(""), F.lit("Z"), F.lit(None).cast("string")), (F.col("event_id") % 7 + 1).cast("int"))


def parse_letter(raw: Column, letters: str) -> tuple[Column, Column]:
    """(letter, reason): exactly one capital letter of the set, blanks around it aside."""
    t = F.trim(raw)
    reason = F.when(raw.isNull(), "no_text").when(t == "", "empty_response").when(~t.rlike("^[A-Z]$"), "not_one_letter").when(F.instr(F.lit(letters), t) == 0, "not_an_option")
    return F.when(reason.isNull(), t), reason


@query(f"""WITH r AS (SELECT event_id, {RAW_SQL} AS raw FROM events),
p AS (SELECT event_id, CASE WHEN raw IS NULL THEN 'no_text' WHEN trim(raw) = '' THEN 'empty_response' WHEN NOT regexp_matches(trim(raw), '^[A-Z]$') THEN 'not_one_letter' WHEN instr('ABCDE', trim(raw)) = 0 THEN 'not_an_option' ELSE 'valid' END AS reason FROM r)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY reason""")
def parsed_letters(spark: SparkSession, d: str) -> DataFrame:
    letter, reason = parse_letter(raw_answer(), "ABCDE")
    return table(spark, d, "events").select(F.coalesce(reason, F.lit("valid")).alias("reason"), letter.alias("letter")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEM}, o AS (SELECT item_id, question, gold AS text, 'gold' AS kind FROM item UNION SELECT item_id, question, d_text, 'd' || rank FROM item WHERE rank < 4 UNION SELECT item_id, question, 'None of these', 'abstain' FROM item),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY 'place-' || substr(sha256(to_json([CAST(item_id AS VARCHAR), kind])), 1, 20)) AS r FROM o)
SELECT item_id, md5('QUESTION' || chr(10) || any_value(question) || chr(10) || 'OPTIONS' || chr(10) || string_agg(substr('ABCDE', CAST(r AS INT), 1) || ') ' || text, chr(10) ORDER BY r)) AS stimulus,
  max(CASE WHEN kind = 'gold' THEN substr('ABCDE', CAST(r AS INT), 1) END) AS gold_letter, max(CASE WHEN kind = 'abstain' THEN substr('ABCDE', CAST(r AS INT), 1) END) AS abstain_letter FROM k GROUP BY item_id""")
def rendered_trials(spark: SparkSession, d: str) -> DataFrame:
    """Options in their seeded order with letters, the rendered text's hash, and where gold and abstention stand."""
    option = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    wrong = F.transform(F.slice("distractors", 1, 3), lambda x: option(F.concat(F.lit("d"), x["rank"].cast("string")), x["d_text"]))
    options = F.concat(F.array(option(F.lit("gold"), F.col("gold"))), wrong, F.array(option(F.lit("abstain"), F.lit("None of these"))))
    keyed = F.transform(options, lambda o: F.struct(I.stable_id("place", F.col("item_id").cast("string"), o["kind"]).alias("k"), o["kind"].alias("kind"), o["text"].alias("text")))
    i = items(spark, d).select("item_id", "question", F.array_sort(keyed).alias("o"))
    lines = F.transform("o", lambda o, n: F.concat(F.substring(F.lit("ABCDE"), n + 1, F.lit(1)), F.lit(") "), o["text"]))
    place = lambda kind: F.substring(F.lit("ABCDE"), F.array_position(F.transform("o", lambda o: o["kind"]), F.lit(kind)).cast("int"), F.lit(1))
    text = F.concat_ws("\n", F.lit("QUESTION"), "question", F.lit("OPTIONS"), F.array_join(lines, "\n"))
    return i.select("item_id", F.md5(text.cast("binary")).alias("stimulus"), place("gold").alias("gold_letter"), place("abstain").alias("abstain_letter"))


@query(f"WITH {TRIAL} SELECT model, " + ", ".join(f"CAST(count(*) FILTER (WHERE letter = '{x}') AS BIGINT) AS \"{x}\"" for x in "ABCDE") + " FROM trial GROUP BY model")
def letters_pivot(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).groupBy("model").pivot("letter", list("ABCDE")).agg(F.count("trial_id")).na.fill(0)


@query(f"""WITH {REQUEST}, r AS (SELECT family, request_key, row_number() OVER (PARTITION BY family ORDER BY submitted_at DESC, request_key DESC) AS r, min(request_key) OVER (PARTITION BY family) AS seen FROM request)
SELECT family, request_key, row_number() OVER (ORDER BY seen) AS position FROM r WHERE r = 1""")
def latest_in_first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    g = requests(spark, d).groupBy("family").agg(F.max(F.struct("submitted_at", "request_key"))["request_key"].alias("request_key"), F.min("request_key").alias("seen"))
    return positions(g, F.col("seen")).select("family", "request_key", "position")


@query("""SELECT event_type, list_sort(list(value))[CAST(floor(0.025 * (count(*) - 1)) AS BIGINT) + 1] AS low, list_sort(list(value))[CAST(floor(0.975 * (count(*) - 1)) AS BIGINT) + 1] AS high FROM events GROUP BY event_type""")
def order_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by rank, rounded down and not interpolated; values are counted before they are gathered."""
    counted = table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    total = counted.groupBy("event_type").agg(F.sum("n").alias("total"))
    at = counted.withColumn("upto", F.sum("n").over(w)).join(total, "event_type")
    rank = lambda p: F.floor(F.lit(p) * (F.col("total") - 1)) + 1
    return at.groupBy("event_type").agg(F.min(F.when(F.col("upto") >= rank(0.025), F.col("value"))).alias("low"), F.min(F.when(F.col("upto") >= rank(0.975), F.col("value"))).alias("high"))


@query("""SELECT user_id, epoch_us(max(began)) AS began FROM (SELECT user_id, ts AS began, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events) WHERE fresh = 1 GROUP BY user_id""")
def last_burst_start(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us")
    e = table(spark, d, "events").select("user_id", us.alias("us"))
    fresh = e.withColumn("gap", F.col("us") - F.lag("us").over(w)).filter("gap is null or gap > 21600000000")
    return fresh.groupBy("user_id").agg(F.max("us").alias("began"))


@query("""WITH n AS (SELECT max(ts) AS now_ FROM events), a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events, n WHERE ts >= now_ - INTERVAL 10 DAY)
SELECT user_id, event_id FROM a WHERE r <= 12""")
def trimmed_samples(spark: SparkSession, d: str) -> DataFrame:
    """At most the last twelve samples of a key, none older than ten days."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    now = e.agg(F.max("us").alias("now"))
    recent = e.join(F.broadcast(now), F.col("us") >= F.col("now") - 10 * 86_400_000_000)  # one row
    w = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))
    return recent.withColumn("r", F.row_number().over(w)).filter("r <= 12").select("user_id", "event_id")


@query(f"""WITH {TRIAL}, s AS (SELECT item_id, list_sort(list_distinct(list(model))) AS seen FROM trial WHERE outcome = 'N1' GROUP BY item_id),
m AS (SELECT item_id, list_filter(['m0','m1','m2','m3','m4','m5','m6','m7'], lambda x: NOT list_contains(seen, x)) AS missing FROM s)
SELECT item_id, CAST(len(missing) AS BIGINT) AS missing, len(missing) > 0 AND len(list_filter(missing, lambda x: x NOT IN ('m1', 'm3', 'm5', 'm7'))) = 0 AS held FROM m""")
def items_held_by_pauses(spark: SparkSession, d: str) -> DataFrame:
    """Items all of whose missing models are paused."""
    every = strings(*(f"m{i}" for i in range(8)))
    m = trials(spark, d).filter("outcome = 'N1'").groupBy("item_id").agg(F.array_except(every, F.collect_set("model")).alias("m"))
    return m.select("item_id", F.size("m").cast("long").alias("missing"), ((F.size("m") > 0) & (F.size(F.array_except("m", strings("m1", "m3", "m5", "m7"))) == 0)).alias("held"))


@query(f"""WITH {REQUEST}, r AS (SELECT request_key, sum(cost) OVER (PARTITION BY family ORDER BY request_key ROWS UNBOUNDED PRECEDING) AS f, sum(cost) OVER (PARTITION BY run_id, stage ORDER BY request_key ROWS UNBOUNDED PRECEDING) AS s, cost FROM request)
SELECT CASE WHEN cost > 400000 THEN 'request' WHEN f > 1500000 THEN 'family' WHEN s > 90000000 THEN 'stage' ELSE 'none' END AS cap, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""")
def caps_at_several_grains(spark: SparkSession, d: str) -> DataFrame:
    upto = lambda *k: Window.partitionBy(*k).orderBy("request_key").rowsBetween(Window.unboundedPreceding, 0)
    r = requests(spark, d).select("cost", F.sum("cost").over(upto("family")).alias("f"), F.sum("cost").over(upto("run_id", "stage")).alias("s"))
    cap = F.when(F.col("cost") > 400_000, "request").when(F.col("f") > 1_500_000, "family").when(F.col("s") > 90_000_000, "stage").otherwise("none")
    return r.groupBy(cap.alias("cap")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z]{2,}')) AS a FROM documents) SELECT doc_id, CAST(len(a) AS BIGINT) AS acronyms FROM t WHERE len(a) > 0""")
def acronym_tokens(spark: SparkSession, d: str) -> DataFrame:
    a = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z]{2,}"), 0))
    return table(spark, d, "documents").select("doc_id", F.size(a).cast("long").alias("acronyms")).filter("acronyms > 0")


@query("""SELECT item_id, regexp_matches(text, '[\\r\\n]|[ \\t\\f\\v]{3,}') OR len(list_filter(regexp_extract_all(text, '["“]([^"“”]{2,})["”]', 1), lambda q: len(regexp_extract_all(q, '\\S+')) > 8)) > 0 AS malformed, length(text) AS n FROM benchmark""")
def malformed_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", V.malformed(F.col("text")).alias("malformed"), F.length("text").cast("long").alias("n"))


@query("""WITH w AS (SELECT item_id, string_split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' ') AS w FROM benchmark), a AS (SELECT item_id, list_filter(w, lambda x: length(x) > 6)[1] AS answer, w FROM w)
SELECT a.item_id, CAST(count(*) FILTER (WHERE list_contains(b.w, a.answer)) AS BIGINT) AS leaks FROM a, a b WHERE b.item_id <> a.item_id AND a.answer IS NOT NULL GROUP BY a.item_id""")
def answer_leaks(spark: SparkSession, d: str) -> DataFrame:
    """How many other questions hold an answer as a whole word; an equi-join on words."""
    w = table(spark, d, "benchmark").select("item_id", F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), " ").alias("w"))
    a = w.select("item_id", F.get(F.filter("w", lambda x: F.length(x) > 6), F.lit(0)).alias("answer")).filter("answer is not null")
    held = w.select(F.col("item_id").alias("other"), F.explode(F.array_distinct("w")).alias("answer"))
    n = a.join(held, "answer").filter("other <> item_id").groupBy("item_id").agg(F.count("*").alias("leaks"))
    return a.join(n, "item_id", "left").select("item_id", F.coalesce("leaks", F.lit(0)).cast("long").alias("leaks"))


@query("""SELECT o_custkey, CAST(count(*) AS BIGINT) AS windows, round(min(o_totalprice), 2) AS least, arg_min(o_orderpriority, (o_totalprice, o_orderkey)) AS tightest FROM orders GROUP BY o_custkey""")
def quota_windows(spark: SparkSession, d: str) -> DataFrame:
    """Nested reports flattened: providers with arrays of windows, the tightest of each."""
    report = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_totalprice", "o_orderkey", "o_orderpriority")).alias("windows"))
    flat = report.select("o_custkey", F.inline("windows"))
    return flat.groupBy("o_custkey").agg(F.count("*").alias("windows"), F.round(F.min("o_totalprice"), 2).alias("least"), F.min_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("tightest"))


@query("""WITH s AS (SELECT l_orderkey AS item, list(l_partkey % 5 ORDER BY l_partkey % 5) AS a FROM lineitem GROUP BY l_orderkey), t AS (SELECT o_orderkey AS item, [o_custkey % 5, (o_custkey + 1) % 5] AS b FROM orders)
SELECT t.item, list_sort(b) = a AS same, len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) = 0 AS covered FROM t JOIN s ON s.item = t.item""")
def multiset_equality(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.array_sort(F.collect_list(F.col("l_partkey") % 5)).alias("a"))
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.array(F.col("o_custkey") % 5, (F.col("o_custkey") + 1) % 5).alias("b"))
    return t.join(s, "item").select("item", (F.array_sort("b") == F.col("a")).alias("same"), (F.size(F.array_except("b", "a")) == 0).alias("covered"))


#: Requests that one family may have, as its schedule is made by one task.
MOST_REQUESTS = 100_000


def waves(group: pd.DataFrame, slots: int) -> pd.DataFrame:
    """Fair waves: each takes up to a share of the slots from every vendor, the scarcest vendor first."""
    if len(group) > MOST_REQUESTS:
        raise ValueError(f"a family has more than {MOST_REQUESTS} requests")
    left = {v: g["request_key"].sort_values().tolist() for v, g in group.groupby("model")}
    return pd.DataFrame(scheduled(left, slots), columns=["request_key", "wave"])


def scheduled(left: dict[str, list[int]], slots: int) -> list[tuple[int, int]]:
    """(request, wave) of the sorted requests of each vendor."""
    rows, wave = [], 0
    while left:
        quota, free = -(-slots // len(left)), slots
        for v in sorted(left, key=lambda v: (len(left[v]), v)):
            take = left[v][: min(quota, free)]
            free -= len(take)
            left[v] = left[v][len(take) :]
            rows += [(k, wave) for k in take]
        left = {v: keys for v, keys in left.items() if keys}
        wave += 1
    return rows


def family_waves(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Schedules of families whose requests lie together, in order of key; a family may go on in the next batch."""

    def out(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["request_key", "wave"])

    family, left, size = None, {}, 0
    for batch in batches:
        done: list[tuple[int, int]] = []
        for own, vendor, key in zip(*(batch.column(c).to_pylist() for c in ("family", "model", "request_key"))):
            if own != family:
                done += scheduled(left, slots)
                family, left, size = own, {}, 0
            size += 1
            if size > MOST_REQUESTS:
                raise ValueError(f"a family has more than {MOST_REQUESTS} requests")
            if vendor is not None:
                left.setdefault(vendor, []).append(key)
        yield out(done)
    yield out(scheduled(left, slots))


@query()
def fair_waves(spark: SparkSession, d: str) -> DataFrame:
    """A greedy schedule per family, the requests of one family being few."""
    rows = requests(spark, d).select("family", "model", "request_key").repartition("family").sortWithinPartitions("family", "request_key")
    return rows.mapInArrow(lambda batches: family_waves(batches, 4), "request_key long, wave long")
