"""Queries that score trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.adapters import TRIAL, trials
from sparkloom.operators import scoring as S
from sparkloom.operators import stats
from sparkloom.operators.lookups import positions
from sparkloom.plans.registry import query

COUNTS_SQL = ", ".join(f"CAST(count(*) FILTER (WHERE outcome = 'N{i}') AS BIGINT) AS n{i}" for i in range(6))


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / CAST(nullif({b}, 0) AS DOUBLE))"


P, R = div("n5", "n3 + n5"), div("n5", "n2 + n4 + n5")
METRIC_SQL = {
    "acc": div("n1 + n5", "n1 + n2 + n3 + n4 + n5"),
    "precision_abs": P,
    "recall_abs": R,
    "f1_abs": f"CASE WHEN {P} + {R} <> 0 THEN 2 * {P} * {R} / ({P} + {R}) END",
    "abstention_rate": div("n3 + n5", "n1 + n2 + n3 + n4 + n5"),
    "r_acc": div("n1", "n1 + n2 + n4"),
    "ssr": div("n1 + n3 + n5", "n1 + n2 + n3 + n4 + n5"),
    "recall_abs_absent_only": div("n5", "n4 + n5"),
    "present_abstention": div("n3", "n1 + n2 + n3"),
    "absent_abstention": div("n5", "n4 + n5"),
    "shift": f"{div('n5', 'n4 + n5')} - {div('n3', 'n1 + n2 + n3')}",
    "accuracy_when_answering": div("n1", "n1 + n2"),
    "gold_rate": div("n1", "n1 + n2 + n3"),
    "false_commitment_rate": div("n4", "n4 + n5"),
}


def metrics_sql(*names: str) -> str:
    return ", ".join(f"round({METRIC_SQL[n]}, 6) AS {n}" for n in names or METRIC_SQL)


@query(f"WITH {TRIAL}, t AS (SELECT model, arm, {COUNTS_SQL} FROM trial GROUP BY model, arm) SELECT *, {metrics_sql()} FROM t")
def score_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.with_metrics(S.tally(trials(spark, d), "model", "arm"))


@query(f"WITH {TRIAL} SELECT model, arm, {COUNTS_SQL} FROM trial GROUP BY model, arm")
def tally_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return S.tally(trials(spark, d), "model", "arm")


@query(f"WITH {TRIAL}, t AS (SELECT model, repeat, {COUNTS_SQL} FROM trial GROUP BY model, repeat), m AS (SELECT model, {metrics_sql('acc', 'f1_abs', 'shift')} FROM t) SELECT model, round(median(acc), 6) AS acc, round(median(f1_abs), 6) AS f1_abs, round(median(shift), 6) AS shift FROM m GROUP BY model")
def trial_medians(spark: SparkSession, d: str) -> DataFrame:
    m = S.with_metrics(S.tally(trials(spark, d), "model", "repeat"), "acc", "f1_abs", "shift")
    return m.groupBy("model").agg(*[F.round(F.median(n), 6).alias(n) for n in ("acc", "f1_abs", "shift")])


@query(f"WITH {TRIAL} SELECT model, coalesce(repeat, 0) AS repeat, {COUNTS_SQL}, CAST(count(*) AS BIGINT) AS trials FROM trial GROUP BY GROUPING SETS ((model), (model, repeat))")
def tally_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    trials(spark, d).createOrReplaceTempView("_trials")
    counted = ", ".join(f"count_if(outcome = 'N{i}') AS n{i}" for i in range(6))
    return spark.sql(f"SELECT model, coalesce(repeat, 0) AS repeat, {counted}, count(*) AS trials FROM _trials GROUP BY GROUPING SETS ((model), (model, repeat))")


@query(f"""WITH {TRIAL}, p AS (SELECT model, item_id, repeat, arg_max(outcome, trial_id) FILTER (WHERE condition = 'gold_present') AS gp,
  arg_max(outcome, trial_id) FILTER (WHERE condition = 'gold_absent') AS ga FROM trial GROUP BY ALL)
SELECT model, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (WHERE gp = 'N1' AND ga = 'N5') AS BIGINT) AS ideal,
  round(count(*) FILTER (WHERE gp = 'N1' AND ga = 'N5') / CAST(count(*) AS DOUBLE), 6) AS ideal_pair_rate FROM p WHERE gp <> 'N0' AND ga <> 'N0' GROUP BY model""")
def ideal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.pair_rate(trials(spark, d), "model")


@query(f"""WITH {TRIAL}, n AS (SELECT model, letter, CAST(count(*) AS BIGINT) AS n FROM trial WHERE outcome <> 'N0' GROUP BY ALL)
SELECT model, letter, n, CAST(sum(n) OVER (PARTITION BY model) AS BIGINT) AS total, round(n / CAST(sum(n) OVER (PARTITION BY model) AS DOUBLE), 4) AS share FROM n""")
def letter_shares(spark: SparkSession, d: str) -> DataFrame:
    return S.letters(trials(spark, d), "model")


@query(f"""WITH {TRIAL}, t AS (SELECT model, arm, CASE WHEN outcome <> 'N0' THEN outcome WHEN condition = 'gold_present' THEN 'N3' ELSE 'N5' END AS outcome FROM trial),
c AS (SELECT model, arm, {COUNTS_SQL} FROM t GROUP BY model, arm) SELECT *, {metrics_sql('acc', 'f1_abs', 'abstention_rate')} FROM c""")
def sensitivity_invalid_as_abstention(spark: SparkSession, d: str) -> DataFrame:
    return S.with_metrics(S.tally(S.as_abstention(trials(spark, d)), "model", "arm"), "acc", "f1_abs", "abstention_rate")


@query(f"WITH {TRIAL} SELECT model, arm, invalid_reason, CAST(count(*) AS BIGINT) AS n FROM trial WHERE outcome = 'N0' GROUP BY ALL")
def invalid_reasons(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).filter("outcome = 'N0'").groupBy("model", "arm", "invalid_reason").agg(F.count("*").alias("n"))


STRATA_SQL = f"""WITH {TRIAL}, s AS (
  SELECT model, arm, outcome, item_id, unnest([
    {{'stratum': 'numeric', 'value': CAST(item_id % 2 = 0 AS VARCHAR)}}, {{'stratum': 'has_context', 'value': CAST(item_id % 3 = 0 AS VARCHAR)}},
    {{'stratum': 'script', 'value': CASE WHEN item_id % 5 = 0 THEN 'mixed' ELSE 'latin' END}}, {{'stratum': 'schema', 'value': coalesce(CASE WHEN item_id % 7 <> 0 THEN 'v' || (item_id % 4) END, 'None')}}]) AS u FROM trial),
c AS (SELECT model, arm, u.stratum AS stratum, u.value AS value, {COUNTS_SQL} FROM s GROUP BY ALL) SELECT *, {metrics_sql('acc', 'f1_abs')} FROM c"""


@query(STRATA_SQL)
def strata_metrics(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    strata = {
        "numeric": i % 2 == 0,
        "has_context": i % 3 == 0,
        "script": F.when(i % 5 == 0, "mixed").otherwise("latin"),
        "schema": F.when(i % 7 != 0, F.concat(F.lit("v"), (i % 4).cast("string"))),
    }
    return S.with_metrics(S.by_stratum(trials(spark, d), strata, "model", "arm"), "acc", "f1_abs")


@query(f"""WITH {TRIAL}, r AS (SELECT *, CASE WHEN item_id % 8 = CAST(substr(model, 2) AS BIGINT) THEN CASE WHEN item_id % 3 = 0 THEN 'both' ELSE 'writer' END WHEN item_id % 3 = 0 THEN 'judge' ELSE 'none' END AS role FROM trial),
i AS (SELECT model, arm, CAST(count(DISTINCT item_id) AS BIGINT) AS items, CAST(count(DISTINCT item_id) FILTER (WHERE role = 'none') AS BIGINT) AS items_without_role, {COUNTS_SQL} FROM r GROUP BY model, arm),
c AS (SELECT model, arm, {COUNTS_SQL} FROM r WHERE role = 'none' GROUP BY model, arm)
SELECT i.model, i.arm, items, items_without_role, round({METRIC_SQL['acc']}, 6) AS acc, (SELECT round({METRIC_SQL['acc']}, 6) FROM c WHERE c.model = i.model AND c.arm = i.arm) AS acc_without_role FROM i""")
def contamination_by_role(spark: SparkSession, d: str) -> DataFrame:
    i, m = F.col("item_id"), F.substring("model", 2, 9).cast("long")
    role = F.when(i % 8 == m, F.when(i % 3 == 0, "both").otherwise("writer")).when(i % 3 == 0, "judge").otherwise("none")
    t = trials(spark, d).withColumn("role", role)
    items = t.groupBy("model", "arm").agg(F.count_distinct("item_id").alias("items"), F.count_distinct(F.when(F.col("role") == "none", F.col("item_id"))).alias("items_without_role"))
    every = S.with_metrics(S.tally(t, "model", "arm"), "acc").select("model", "arm", "acc")
    clean = S.with_metrics(S.tally(t.filter("role = 'none'"), "model", "arm"), "acc").select("model", "arm", F.col("acc").alias("acc_without_role"))
    return items.join(every, ["model", "arm"]).join(clean, ["model", "arm"], "left")


SHIFT_SQL = f"""WITH {TRIAL}, g AS (SELECT model, item_id, count(*) FILTER (WHERE condition = 'gold_present') AS p, count(*) FILTER (WHERE condition = 'gold_absent') AS a,
  count(*) FILTER (WHERE outcome = 'N3') AS p3, count(*) FILTER (WHERE outcome = 'N5') AS a5 FROM trial WHERE outcome <> 'N0' GROUP BY ALL),
s AS (SELECT model, item_id, a5 / CAST(a AS DOUBLE) - p3 / CAST(p AS DOUBLE) AS shift FROM g WHERE p > 0 AND a > 0)"""


@query(f"""{SHIFT_SQL} SELECT model, CAST(count(*) AS BIGINT) AS questions, round(avg(shift), 6) AS mean_shift, CAST(count(*) FILTER (WHERE shift > 1e-12) AS BIGINT) AS positive,
  CAST(count(*) FILTER (WHERE shift < -1e-12) AS BIGINT) AS negative, CAST(count(*) FILTER (WHERE abs(shift) <= 1e-12) AS BIGINT) AS zero FROM s GROUP BY model""")
def shift_signs(spark: SparkSession, d: str) -> DataFrame:
    return S.shift_signs(S.question_shift(trials(spark, d), "model"), "model")


@query(f"""{SHIFT_SQL}, m AS (SELECT item_id, avg(shift) AS shift FROM s GROUP BY item_id)
SELECT CAST(count(*) AS BIGINT) AS questions, round(avg(shift), 6) AS mean_shift, CAST(count(*) FILTER (WHERE shift > 1e-12) AS BIGINT) AS positive FROM m""")
def pooled_shift(spark: SparkSession, d: str) -> DataFrame:
    per_item = S.question_shift(trials(spark, d), "model").groupBy("item_id").agg(F.avg("shift").alias("shift"))
    return per_item.agg(F.count("*").alias("questions"), F.round(F.avg("shift"), 6).alias("mean_shift"), F.count_if(F.col("shift") > 1e-12).alias("positive"))


@query()
def shift_sign_flip_tests(spark: SparkSession, d: str) -> DataFrame:
    tests = stats.sign_flip_test(S.question_shift(trials(spark, d), "model"), "model")
    return stats.holm(tests, ["model"])


@query()
def pooled_shift_test(spark: SparkSession, d: str) -> DataFrame:
    """One sign-flip test over all models: each question gives its mean shift over them."""
    per_item = S.question_shift(trials(spark, d), "model").groupBy("item_id").agg(F.avg("shift").alias("shift"))
    p = stats.sign_flip_test(per_item.withColumn("test", F.lit("pooled")), "test", blocks=16)
    signs = per_item.agg(F.round(F.avg("shift"), 6).alias("mean_shift"), F.count_if(F.col("shift") > 1e-12).alias("positive"), F.count_if(F.col("shift") < -1e-12).alias("negative"))
    return p.crossJoin(F.broadcast(signs))  # one row each


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of every metric and of the rate of ideal pairs."""
    return stats.bootstrap(trials(spark, d).filter("outcome <> 'N0'"), "model")


@query("""WITH p AS (SELECT o_orderpriority AS name, count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) * 20 AS DOUBLE) AS p_value FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p_value, name) AS r, count(*) OVER () AS n FROM p)
SELECT name, round(p_value, 8) AS p_value, round(max(least(1.0, (n - r + 1) * p_value)) OVER (ORDER BY p_value, name ROWS UNBOUNDED PRECEDING), 8) AS holm FROM r""")
def holm_adjusted(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    p = o.groupBy(F.col("o_orderpriority").alias("name")).agg((F.count_if(F.expr("o_orderstatus = 'F'")) / (F.count("*") * 20).cast("double")).alias("p_value"))
    return stats.holm(p, ["name"]).select("name", F.round("p_value", 8).alias("p_value"), F.round("holm", 8).alias("holm"))


@query("""WITH s AS (SELECT l.quality, floor(d.n_chars / 100) AS score FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM s GROUP BY score),
w AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0) AS won FROM c)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(CAST(sum(won) AS DOUBLE) / (sum(p) * sum(n)), 6) AS auc FROM w""")
def rank_auc(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.floor(F.col("n_chars") / 100).alias("score")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return stats.auc(s, "score", F.col("quality") == 1)


@query("""WITH s AS (SELECT l.quality, row_number() OVER (ORDER BY d.n_chars DESC, d.doc_id) AS r, count(*) OVER () AS n FROM documents d JOIN labels l USING (doc_id))
SELECT r <= greatest(1, n // 10) AS top, CAST(count(*) AS BIGINT) AS n, CAST(sum(quality) AS BIGINT) AS accepted, round(avg(CAST(quality AS DOUBLE)), 6) AS rate FROM s GROUP BY 1""")
def top_decile_lift(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    ranked = positions(s, F.struct((-F.col("n_chars")).alias("n"), "doc_id"), "rank")
    marked = ranked.withColumn("top", F.col("rank") <= max(1, s.count() // 10))
    return marked.groupBy("top").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("accepted"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("rate"))


@query(f"WITH {TRIAL} SELECT model, CAST(CAST(sum(cost_usd) AS DECIMAL(28,6)) AS DOUBLE) AS cost, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(tokens), 6) AS mean_tokens, median(tokens) AS median_tokens, max(tokens) AS max_tokens, round(count(*) FILTER (WHERE outcome = 'N0') / CAST(count(*) AS DOUBLE), 6) AS invalid_rate FROM trial GROUP BY model")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).groupBy("model").agg(
        F.sum("cost_usd").cast("double").alias("cost"),
        F.sum("tokens").alias("tokens"),
        F.round(F.avg("tokens"), 6).alias("mean_tokens"),
        F.median("tokens").alias("median_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.round(F.count_if(F.expr("outcome = 'N0'")) / F.count("*"), 6).alias("invalid_rate"),
    )


@query(f"WITH {TRIAL} SELECT model, arm, CAST(count(*) AS BIGINT) AS trials, CAST(CAST(sum(cost_usd) AS DECIMAL(28,6)) AS DOUBLE) AS cost FROM trial GROUP BY ROLLUP (model, arm)")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).rollup("model", "arm").agg(F.count("*").alias("trials"), F.sum("cost_usd").cast("double").alias("cost"))


@query(f"WITH {TRIAL} SELECT model, round(CAST(count(*) FILTER (WHERE outcome = 'N1') AS DOUBLE) / count(*), 6) AS value FROM trial GROUP BY model")
def custom_statistic(spark: SparkSession, d: str) -> DataFrame:
    f = lambda c: c["n1"] / sum(c[f"n{i}"] for i in range(6))
    return stats.custom_statistic(trials(spark, d), "model", f).withColumn("value", F.round("value", 6))
