"""Queries of spans, lineages, gates, budgets, change capture and numeric evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.adapters import CANDIDATE, EVENT, REQUEST, TRIAL, candidates, requests, table, trials, validation_events
from sparkloom.operators.lookups import positions
from sparkloom.operators.prefilter import strings, type_tokens
from sparkloom.plans.registry import query


@query(f"""WITH {REQUEST}, r AS (SELECT request_key, run_id, family, sum(cost) OVER (PARTITION BY family ORDER BY submitted_at, request_key ROWS UNBOUNDED PRECEDING) AS spent FROM request)
SELECT request_key, spent <= 500000 AS admitted, CAST(spent AS DOUBLE) AS spent FROM r""")
def budget_reservations(spark: SparkSession, d: str) -> DataFrame:
    """Whether a request still fits its family's ceiling, all before it included."""
    w = Window.partitionBy("family").orderBy("submitted_at", "request_key").rowsBetween(Window.unboundedPreceding, 0)
    r = requests(spark, d).withColumn("spent", F.sum("cost").over(w))
    return r.select("request_key", (F.col("spent") <= 500_000).alias("admitted"), F.col("spent").cast("double").alias("spent"))


REPLAY_SQL = """r AS (SELECT sequence, list_filter(list_transform(regexp_split_to_array(type, '[;,]'), lambda x: lower(trim(x))), lambda x: x <> '') AS old,
  CASE sequence % 3 WHEN 0 THEN ['review'] WHEN 1 THEN ['news', 'editorial'] ELSE CAST([] AS VARCHAR[]) END AS new FROM candidate),
x AS (SELECT sequence, list_filter(old, lambda x: NOT list_contains(new, x)) AS removed, list_filter(new, lambda x: NOT list_contains(old, x)) AS added, old, new FROM r)"""


def replayed(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    i = F.col("sequence") % 3
    c = candidates(spark, d).select("sequence", type_tokens(F.col("type")).alias("old"), F.when(i == 0, strings("review")).when(i == 1, strings("news", "editorial")).otherwise(none).alias("new"))
    return c.select("sequence", F.array_except("old", "new").alias("removed"), F.array_except("new", "old").alias("added"), "old", "new")


@query(f"WITH {CANDIDATE}, {REPLAY_SQL} SELECT sequence, CAST(len(removed) AS BIGINT) AS n_removed, CAST(len(added) AS BIGINT) AS n_added, len(old) > 0 AND len(new) = 0 AS freed, len(old) = 0 AND len(new) > 0 AS regressed FROM x")
def replayed_reasons(spark: SparkSession, d: str) -> DataFrame:
    return replayed(spark, d).select("sequence", F.size("removed").cast("long").alias("n_removed"), F.size("added").cast("long").alias("n_added"), ((F.size("old") > 0) & (F.size("new") == 0)).alias("freed"), ((F.size("old") == 0) & (F.size("new") > 0)).alias("regressed"))


@query(f"WITH {CANDIDATE}, {REPLAY_SQL} SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(removed) AS reason FROM x) GROUP BY reason")
def removed_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return replayed(spark, d).select(F.explode("removed").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {REQUEST}, c AS (SELECT unnest(['completed', 'submitted', 'ambiguous_charge', 'failed', 'expired']) AS state)
SELECT c.state, CAST(count(r.request_key) AS BIGINT) AS n FROM c LEFT JOIN request r ON r.state = c.state GROUP BY c.state""")
def zero_filled_states(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.range(1).select(F.explode(strings("completed", "submitted", "ambiguous_charge", "failed", "expired")).alias("state"))
    n = requests(spark, d).groupBy("state").agg(F.count("*").alias("n"))
    return classes.join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"""WITH {CANDIDATE}, {EVENT}, p AS (SELECT DISTINCT item_id FROM validation WHERE pass = 1)
SELECT sequence, sequence IN (SELECT item_id FROM p) AS prior, row_number() OVER (ORDER BY (sequence IN (SELECT item_id FROM p)) DESC, coalesce(length(text), 0) DESC, sequence) AS rank FROM candidate""")
def prior_first_selection(spark: SparkSession, d: str) -> DataFrame:
    p = validation_events(spark, d).filter("pass = 1").select(F.col("item_id").alias("sequence")).distinct().withColumn("prior", F.lit(True))
    c = candidates(spark, d).select("sequence", F.length("text").alias("n")).join(p, "sequence", "left").withColumn("prior", F.coalesce("prior", F.lit(False)))
    return positions(c, F.struct((~F.col("prior")).alias("later"), (-F.coalesce("n", F.lit(0))).alias("n"), "sequence"), "rank").select("sequence", "prior", "rank")


@query("""WITH s AS (SELECT doc_id, least(length(text) / 5000.0, 1.0) AS a, (1 + doc_id % 9) / 10.0 AS b FROM documents)
SELECT doc_id, round(pow(a, 0.5) * pow(b, 0.5), 6) AS probability, row_number() OVER (ORDER BY round(pow(a, 0.5) * pow(b, 0.5), 6) DESC, doc_id) AS rank FROM s""")
def prescreen_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Gate and quality weigh one half each, geometrically."""
    gate, quality = F.least(F.length("text") / 5000.0, F.lit(1.0)), (1 + F.col("doc_id") % 9) / 10.0
    s = table(spark, d, "documents").select("doc_id", F.round(F.pow(gate, F.lit(0.5)) * F.pow(quality, F.lit(0.5)), 6).alias("probability"))
    return positions(s, F.struct((-F.col("probability")).alias("p"), "doc_id"), "rank")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM l),
b AS (SELECT doc_id, i, strlen(l[i]) AS n FROM e)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line, CAST(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - n - 1 AS BIGINT) AS start_byte, CAST(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS end_byte FROM b""")
def byte_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines by their UTF-8 bytes; offsets add up within the row, without a shuffle."""
    lines = F.split("text", "\n", -1)
    spans = F.aggregate(
        lines,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.octet_length(x) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), (a["at"] + F.octet_length(x)).alias("e")))).alias("out")),
        lambda a: a["out"],
    )
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(spans).alias("line", "x"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.col("x.s").alias("start_byte"), F.col("x.e").alias("end_byte"))


@query("SELECT 0 AS violations")
def contiguous_spans_gate(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line")
    broken = byte_spans(spark, d).withColumn("before", F.lag("end_byte").over(w)).filter(F.col("start_byte") != F.coalesce(F.col("before") + 1, F.lit(0)))
    return broken.agg(F.count("*").cast("int").alias("violations"))


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT DISTINCT source, doc_id, regexp_replace(lower(line), '[0-9]+', '#', 'g') AS k FROM l WHERE length(line) BETWEEN 10 AND 120),
n AS (SELECT source, k, count(*) AS pages FROM k GROUP BY ALL), t AS (SELECT source, count(*) AS total FROM documents GROUP BY source)
SELECT n.source, md5(k) AS k, CAST(pages AS BIGINT) AS pages FROM n JOIN t ON t.source = n.source WHERE pages >= 3 AND pages * 20 >= total""")
def running_heads(spark: SparkSession, d: str) -> DataFrame:
    """Lines that many pages of a source share, digits aside."""
    docs = table(spark, d, "documents")
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.length("line").between(10, 120))
    keys = lines.select("source", "doc_id", F.regexp_replace(F.lower("line"), "[0-9]+", "#").alias("k")).distinct()
    n = keys.groupBy("source", "k").agg(F.count("*").alias("pages")).filter("pages >= 3")
    total = docs.groupBy("source").agg(F.count("*").alias("total"))
    return n.join(total, "source").filter("pages * 20 >= total").select("source", F.md5(F.col("k").cast("binary")).alias("k"), "pages")


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations)
SELECT conv_id, CAST(section AS BIGINT) AS section, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(n) AS BIGINT) AS characters FROM t GROUP BY ALL""")
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    """A heading (here a user's turn) begins a section; sections are a running sum."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, d, "conversations").withColumn("section", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    return t.groupBy("conv_id", F.col("section").cast("long").alias("section")).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"))


# Factors to the base unit.
UNITS = {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001}
UNIT_SQL = "u AS (SELECT unnest(['m', 'km', 'cm', 'mm']) AS unit, unnest([1.0, 1000.0, 0.01, 0.001]) AS factor)"


@query(f"""WITH {UNIT_SQL}, v AS (SELECT event_id, CAST(value AS DOUBLE) AS value, CASE event_id % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'km' WHEN 2 THEN 'cm' ELSE 'mm' END AS unit, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS claimed FROM events)
SELECT event_id, round(value * CAST(factor AS DOUBLE), 6) AS metres, abs(value * CAST(factor AS DOUBLE) - claimed) <= 5 AS equal FROM v JOIN u ON u.unit = v.unit""")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    unit = F.element_at(strings("m", "km", "cm", "mm"), (F.col("event_id") % 4 + 1).cast("int"))
    metres = F.col("value") * factor[unit]
    return table(spark, d, "events").select("event_id", F.round(metres, 6).alias("metres"), (F.abs(metres - F.get_json_object("props", "$.k").cast("double")) <= 5).alias("equal"))


@query("""WITH n AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS n FROM documents)
SELECT doc_id, CAST(len(n) AS BIGINT) AS literals, coalesce(max_by_, '') AS longest, CAST(len(list_distinct(n)) AS BIGINT) AS different FROM (SELECT doc_id, n, (SELECT max(lpad(x, 40, '0')) FROM (SELECT unnest(n) AS x)) AS max_by_ FROM n)""")
def numeric_literals(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract_all("text", F.lit("[0-9]+"), 0)
    return table(spark, d, "documents").select("doc_id", F.size(n).cast("long").alias("literals"), F.coalesce(F.array_max(F.transform(n, lambda x: F.lpad(x, 40, "0"))), F.lit("")).alias("longest"), F.size(F.array_distinct(n)).cast("long").alias("different"))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0))


@query("""WITH p AS (SELECT a.item_id, list_distinct(regexp_extract_all(lower(a.text), '[a-z]+')) AS l, list_distinct(regexp_extract_all(lower(b.text), '[a-z]+')) AS r
  FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT item_id, len(list_filter(l, lambda x: NOT list_contains(r, x))) = 0 AS entailed, CAST(len(list_filter(l, lambda x: list_contains(r, x))) AS BIGINT) AS common FROM p""")
def scope_entailment(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    p = b.select("item_id", tokens(F.col("text")).alias("l")).join(b.select((F.col("item_id") - 1).alias("item_id"), tokens(F.col("text")).alias("r")), "item_id")
    return p.select("item_id", (F.size(F.array_except("l", "r")) == 0).alias("entailed"), F.size(F.array_intersect("l", "r")).cast("long").alias("common"))


@query("""WITH a AS (SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 11 <> 0)
SELECT conv_id, turn FROM a WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM a p WHERE p.conv_id = a.conv_id AND p.turn = a.turn - 1)""")
def orphan_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts whose parent is missing; a lineage is whole if there are none."""
    a = table(spark, d, "conversations").select("conv_id", "turn").filter("(conv_id + turn) % 11 <> 0")  # some attempts are lost
    return a.filter("turn > 0").join(a.select("conv_id", (F.col("turn") + 1).alias("turn")), ["conv_id", "turn"], "left_anti")


@query("""WITH o AS (SELECT doc_id AS k, source AS v FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id AS k, CASE WHEN doc_id % 7 = 0 THEN 'moved' ELSE source END AS v FROM documents WHERE doc_id % 6 <> 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' ELSE 'update' END AS op FROM o FULL JOIN n ON n.k = o.k WHERE o.k IS NULL OR n.k IS NULL OR o.v <> n.v""")
def change_capture(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("source").alias("v"))
    old = t.filter("k % 5 <> 0").withColumnRenamed("v", "o")
    new = t.filter("k % 6 <> 0").withColumn("n", F.when(F.col("k") % 7 == 0, "moved").otherwise(F.col("v"))).drop("v")
    j = old.join(new, "k", "full")
    op = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("o") != F.col("n"), "update")
    return j.select("k", op.alias("op")).filter("op is not null")


@query("""SELECT o_custkey % 3 AS vendor, CAST(sum(o_totalprice) AS DECIMAL(28,2))::DOUBLE AS cost, CAST(count(*) AS BIGINT) AS calls, CAST(max(o_orderkey) AS BIGINT) AS questions, round(CAST(sum(o_totalprice) AS DOUBLE) / max(o_orderkey) * 10000, 2) AS projected FROM orders GROUP BY 1""")
def vendor_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 3).alias("vendor"))
    spent = F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    return o.agg(spent.cast("double").alias("cost"), F.count("*").alias("calls"), F.max("o_orderkey").alias("questions"), F.round(spent.cast("double") / F.max("o_orderkey") * 10_000, 2).alias("projected"))


@query("""WITH r AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM events)
SELECT user_id, CAST(count(*) FILTER (WHERE value > before_) AS BIGINT) AS reopened, CAST(count(*) AS BIGINT) AS rows FROM r GROUP BY user_id""")
def reopened_items(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").withColumn("before", F.max("value").over(w)).groupBy("user_id").agg(F.count_if(F.col("value") > F.col("before")).alias("reopened"), F.count("*").alias("rows"))


@query(f"""WITH {TRIAL}, m AS (SELECT item_id, outcome, count(*) AS n FROM trial GROUP BY ALL) SELECT outcome, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS items FROM m GROUP BY outcome""")
def merged_outcome_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps of counts per item, merged by key."""
    per = trials(spark, d).groupBy("item_id", "outcome").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("outcome", "n"))).alias("m"))
    return per.select(F.explode("m").alias("outcome", "n")).groupBy("outcome").agg(F.sum("n").alias("n"), F.count("*").alias("items"))


@query("""WITH l AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY user_id)
SELECT user_id, sha256(to_json(kinds)) AS fingerprint, CAST(len(kinds) AS BIGINT) AS n FROM l""")
def verdict_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    return k.select("user_id", F.sha2(F.to_json("k"), 256).alias("fingerprint"), F.size("k").cast("long").alias("n"))


@query("""WITH p AS (SELECT user_id, min(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 ELSE 5 END) AS p FROM events WHERE value > 20 GROUP BY user_id)
SELECT user_id, ['error', 'purchase', 'signup', 'click', 'view'][p] AS layer FROM p""")
def first_failure_layer(spark: SparkSession, d: str) -> DataFrame:
    order = strings("error", "purchase", "signup", "click", "view")
    p = table(spark, d, "events").filter("value > 20").groupBy("user_id").agg(F.min(F.array_position(order, F.col("event_type"))).alias("p"))
    return p.select("user_id", F.element_at(order, F.col("p").cast("int")).alias("layer"))


@query(f"""WITH {REQUEST} SELECT family, epoch_us(max(submitted_at) FILTER (WHERE state = 'completed')) AS completed_at, epoch_us(max(submitted_at)) AS last_at, CASE WHEN count(*) FILTER (WHERE state = 'ambiguous_charge') > 0 THEN 'review' WHEN count(*) FILTER (WHERE state = 'submitted') > 0 THEN 'open' ELSE 'done' END AS state
FROM request GROUP BY family HAVING count(*) FILTER (WHERE state = 'completed') > 0""")
def family_states(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros("submitted_at")
    s = F.collect_set("state")
    g = requests(spark, d).groupBy("family").agg(F.max(F.when(F.col("state") == "completed", at)).alias("completed_at"), F.max(at).alias("last_at"), s.alias("s"))
    state = F.when(F.array_contains("s", "ambiguous_charge"), "review").when(F.array_contains("s", "submitted"), "open").otherwise("done")
    return g.filter("completed_at is not null").select("family", "completed_at", "last_at", state.alias("state"))


@query("""WITH j AS (SELECT d.doc_id, l.quality, length(d.text) > 1000 AS passed FROM documents d JOIN labels l USING (doc_id))
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN quality = 1 THEN CAST(passed AS INT) END), 6) AS must_pass_rate, CAST(count(*) FILTER (WHERE quality = 0 AND passed) AS BIGINT) AS must_fail_passed FROM j""")
def calibration_gate(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", (F.length("text") > 1_000).alias("passed")).join(table(spark, d, "labels"), "doc_id")
    return j.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("quality") == 1, F.col("passed").cast("int"))), 6).alias("must_pass_rate"), F.count_if((F.col("quality") == 0) & F.col("passed")).alias("must_fail_passed"))


@query("""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 2 >= length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS verifiable FROM documents""")
def verifiable_script(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.length(F.regexp_replace("text", "[^A-Za-z]", "")) * 2 >= F.length(F.regexp_replace("text", r"[^\p{L}]", ""))).alias("verifiable"))


@query("""WITH p AS (SELECT event_id, user_id, ts AS began, ts + INTERVAL 12 HOUR AS until_ FROM events WHERE event_type = 'error'), n AS (SELECT max(ts) AS now_ FROM events)
SELECT user_id, CAST(count(*) AS BIGINT) AS pauses, epoch_us(max(until_)) AS resume_at FROM p, n WHERE until_ > now_ GROUP BY user_id""")
def active_pauses(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    now = e.agg(F.max("us").alias("now"))
    p = e.filter("event_type = 'error'").withColumn("until", F.col("us") + 12 * 3_600_000_000)
    live = p.join(F.broadcast(now), F.col("until") > F.col("now"))  # one row
    return live.groupBy("user_id").agg(F.count("*").alias("pauses"), F.max("until").alias("resume_at"))


@query("""SELECT p_brand, CAST(count(DISTINCT p_type) AS BIGINT) AS types, median(p_retailprice) AS median_price, round(quantile_disc(p_retailprice, 0.5), 2) AS low_median, CAST(count(*) FILTER (WHERE p_size > 25) AS BIGINT) AS large FROM part GROUP BY p_brand""")
def group_statistics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy("p_brand")
    return p.agg(F.count_distinct("p_type").alias("types"), F.median("p_retailprice").alias("median_price"), F.round(F.expr("percentile_disc(0.5) within group (order by p_retailprice)"), 2).alias("low_median"), F.count_if(F.col("p_size") > 25).alias("large"))


@query("""SELECT r_name, n_name, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, CAST(count(o_orderkey) AS BIGINT) AS orders, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS spent
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL""")
def report_by_region(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    spent = t("orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    c = t("customer").join(spent, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"), F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("spent"))
    return t("nation").join(c, "n_nationkey").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "customers", "orders", "spent")
