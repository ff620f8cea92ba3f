"""Queries that decide on candidates: leaks of answers, scopes, claims, verdicts on options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.adapters import ITEM, items, table
from sparkloom.functions import validation as V
from sparkloom.functions import verdicts as J
from sparkloom.functions.text import normalize
from sparkloom.operators.prefilter import strings
from sparkloom.plans.registry import query


def flat_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


def match_sql(c: str) -> str:
    t = f"regexp_replace({flat_sql(c)}, '^(yes|no)\\s*[,;:]?\\s+', '')"
    return flat_sql(f"trim(replace(regexp_replace({t}, '[^\\pL\\pN_%°.+−-]+', ' ', 'g'), '. ', ' '), '.')")


def holds_sql(text: str, phrase: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\pL\\pN_])' || regexp_escape({phrase}) || '($|[^\\pL\\pN_])')"


@query(f"""WITH t AS (SELECT a.conv_id, a.turn, a.text AS question, b.text || ' ' || (a.turn % 3) || ' m' AS context,
  array_to_string(list_slice(string_split(CASE WHEN (a.conv_id + a.turn) % 3 = 0 THEN a.text ELSE b.text END, ' '), 2, 4), ' ') AS w
  FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
m AS (SELECT conv_id, turn, {match_sql("question")} AS q, {match_sql("context")} AS c, {match_sql("w")} AS a FROM t)
SELECT conv_id, turn, coalesce(q <> '' AND a NOT IN ('', 'yes', 'no') AND {holds_sql("q", "a")}, false) AS in_question,
  coalesce(c <> '' AND (turn % 3 = conv_id % 3 AND a IS NOT NULL OR length(a) >= {J.SHORTEST_IN_CONTEXT} AND {holds_sql("c", "a")}), false) AS in_context FROM m""")
def answer_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Turns as questions, the next as their context: whether either gives the answer away."""
    c = table(spark, d, "conversations")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    t = c.join(following, ["conv_id", "turn"], "left")
    words = F.array_join(F.slice(F.split(F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("text")).otherwise(F.col("next")), " "), 2, 3), " ")
    answers = F.array(F.concat(words, F.lit(" "), F.col("conv_id") % 3, F.lit(" kg")), words)
    context = F.concat("next", F.lit(" "), F.col("turn") % 3, F.lit(" m"))
    return t.select("conv_id", "turn", J.question_leak(F.col("text"), answers).alias("in_question"), J.context_leak(context, answers).alias("in_context"))


@query("""WITH o AS (SELECT o_orderkey, 1990 + o_orderkey % 20 AS a, 1985 + o_custkey % 30 AS b, o_orderkey % 4 AS kind FROM orders)
SELECT o_orderkey, kind < 3 AND CASE kind WHEN 0 THEN b <> a WHEN 1 THEN b < a OR b > a + 3 ELSE b <> a AND b <> a - 3 END AS contradict,
  CAST(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS years FROM o""")
def scope_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Scopes of a year, a range, a range written backwards or none against a year."""
    a, b, kind = 1990 + F.col("o_orderkey") % 20, 1985 + F.col("o_custkey") % 30, F.col("o_orderkey") % 4
    left = (
        F.when(kind == 0, F.concat(F.lit("summer of "), a))
        .when(kind == 1, F.concat(F.lit("From "), a, F.lit("–"), a + 3, F.lit(", daily")))
        .when(kind == 2, F.concat(a, F.lit(" to "), a - 3))
        .otherwise(F.concat(F.lit("1"), a, F.lit(" sites")))
    )
    o = table(spark, d, "orders").select("o_orderkey", left.alias("l"), F.concat(F.lit("in "), b).alias("r"))
    return o.select("o_orderkey", J.scopes_contradict(F.col("l"), F.col("r")).alias("contradict"), F.size(J.calendar_years(F.col("l"))).cast("long").alias("years"))


TYPES = ("causal", "observation", "association", "definition")


@query(f"""WITH n AS (SELECT {list(TYPES)} AS t), e AS (SELECT event_id, t[1 + event_id % 4] AS answer, CASE WHEN event_id % 9 <> 0 THEN t[1 + user_id % 4] END AS one, t[1 + event_id // 4 % 4] AS two FROM events, n),
r AS (SELECT (one = 'causal') <> (two = 'causal') AS disagree, answer IN ('observation', 'association') AND (coalesce(one = 'causal', false) OR two = 'causal') AS over FROM e)
SELECT concat_ws(' ', CASE WHEN disagree THEN 'question_claim_type_disagreement' END, CASE WHEN over THEN 'causal_overclaim' END) AS reasons, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""")
def claim_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Labels of an answer and of its two judges, one of whom may have none."""
    of = lambda i: F.element_at(strings(*TYPES), (i % 4 + 1).cast("int"))
    i = F.col("event_id")
    r = J.claim_type_reasons(of(i), F.when(i % 9 != 0, of(F.col("user_id"))), of(F.floor(i / 4)))
    return table(spark, d, "events").groupBy(F.array_join(r, " ").alias("reasons")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id % 5 <> 0 AS contradicted, event_id % 2 = 0 AS newer, event_id % 3 <> 0 AS standalone, event_id % 7 <> 0 AS searched, event_id % 11 < 6 AS admitted, event_id % 13 < 7 AS told FROM events),
r AS (SELECT CASE WHEN NOT contradicted THEN 'option_contradiction_unresolved' WHEN newer AND NOT standalone THEN 'option_standalone_uninterpretable' WHEN newer AND admitted AND NOT told THEN 'option_admission_unexplained'
  WHEN NOT newer AND NOT searched THEN 'distractor_alternative_answer_possible' WHEN admitted THEN 'option_correct_under_question_interpretation' END AS reason FROM e)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""")
def option_verdicts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    reading = F.when(i % 13 < 3, "read so").when(i % 13 < 7, "or so").when(i % 13 < 10, " ")
    r = J.option_verdict_reason(i % 5 != 0, i % 2 == 0, F.when(i % 3 != 0, F.lit(True)), i % 7 != 0, i % 11 < 6, reading)
    return table(spark, d, "events").groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {ITEM}, o AS (SELECT item_id, rank, gold, CASE WHEN rank = 1 AND item_id % 5 = 0 THEN 'None of the  above' WHEN rank = 2 AND item_id % 3 = 0 THEN ' ' || gold || ' ' WHEN rank >= 3 AND item_id % 4 = 0 THEN 'Value 12 m' WHEN rank = 2 THEN d_text ELSE 'Option ' || rank END AS t FROM item),
f AS (SELECT *, {flat_sql("t")} AS flat, row_number() OVER (PARTITION BY item_id, {flat_sql("t")} ORDER BY rank) > 1 AS repeated, t = 'Value 12 m' AS numeric FROM o)
SELECT item_id, rank, CASE WHEN repeated THEN 'duplicate_or_equivalent_distractor' WHEN flat = {flat_sql("gold")} THEN 'distractor_matches_answer' WHEN flat = 'none of the above' THEN 'forbidden_meta_option'
  WHEN regexp_matches(flat, '{V.NEGATION}') THEN 'displayed_assertion_negated' WHEN contains(t, ';') OR regexp_matches(flat, '{V.CONNECTIVE}') OR contains(flat, 'followed by') THEN 'displayed_assertion_compound'
  WHEN numeric AND item_id % 8 <> 0 THEN 'numeric_metadata_display_mismatch' WHEN numeric AND item_id % 16 = 0 THEN 'distractor_is_equivalent_numeric_answer' END AS reason FROM f""")
def option_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Options that go before any model looks at them, by the first reason."""
    i = F.col("item_id")

    def shown(o):
        text = F.when((o["rank"] == 1) & (i % 5 == 0), "None of the  above").when((o["rank"] == 2) & (i % 3 == 0), F.concat(F.lit(" "), "gold", F.lit(" ")))
        return F.struct(o["rank"].alias("rank"), text.when((o["rank"] >= 3) & (i % 4 == 0), "Value 12 m").when(o["rank"] == 2, o["d_text"]).otherwise(F.concat(F.lit("Option "), o["rank"])).alias("t"))

    o = items(spark, d).select("item_id", "gold", F.transform("distractors", shown).alias("all")).select("item_id", "gold", "all", F.inline("all"))
    t, number = F.col("t"), F.when(i % 8 == 0, "12").otherwise("13")
    repeated = F.exists("all", lambda x: (x["rank"] < F.col("rank")) & (normalize(x["t"]) == normalize(t)))
    is_number = t == "Value 12 m"
    same = is_number & V.numeric_equal(F.when(i % 16 == 0, "1200").otherwise("9"), F.lit("cm"), F.lit("0"), number, F.lit("m"))
    reason = J.option_reason(t, F.array("gold"), repeated, F.lit(False), F.lit(None).cast("string"), V.assertion_issue(t), F.when(is_number, V.numeric_display_issue(t, number, F.lit("m"))), same)
    return o.select("item_id", F.col("rank").cast("long").alias("rank"), reason.alias("reason"))


@query("""WITH e AS (SELECT event_id % 3 = 0 AS q, event_id % 5 = 0 AS c, event_id % 7 AS rule, event_id % 2 AS absent, event_id % 11 AS j FROM events)
SELECT concat_ws(' ', CASE WHEN q THEN 'question_answer_leakage' END, CASE WHEN c THEN 'question_context_answer_leakage' END, CASE WHEN rule = 0 THEN 'source_dependent_locator' END,
    CASE WHEN absent = 0 THEN 'standalone_answer_leakage' END, CASE WHEN j < 4 THEN 'standalone_undefined_term' END, CASE WHEN j < 2 THEN 'standalone_multiple_interpretations' END, CASE WHEN j = 5 AND absent <> 0 THEN 'standalone_answer_leakage' END) AS reasons,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN j < 4 AND rule < 3 OR j < 2 AND NOT c THEN 1 ELSE 0 END) AS BIGINT) AS unevidenced FROM e GROUP BY 1""")
def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Reasons against displayed tasks, and how many verdicts name no evidence."""
    i = F.col("event_id")
    judged = F.when(i % 11 < 2, strings("undefined_term", "multiple_interpretations")).when(i % 11 < 4, strings("undefined_term", "undefined_term")).when(i % 11 == 5, strings("answer_leakage"))
    bare = J.unevidenced(judged.isNull(), judged, F.when(i % 7 >= 3, strings("it")).otherwise(strings(" ")), F.when(i % 5 == 0, strings("so", "or so")).otherwise(strings("so", "")))
    reasons = J.gate_reasons(i % 3 == 0, i % 5 == 0, F.when(i % 7 == 0, "source_dependent_locator"), F.when(i % 2 == 0, F.lit(False)), judged)
    return table(spark, d, "events").groupBy(F.array_join(reasons, " ").alias("reasons")).agg(F.count("*").alias("n"), F.count_if(bare).alias("unevidenced"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS kind, o_custkey % 90 AS a, 1 + o_orderkey % 9 AS b FROM orders)
SELECT o_orderkey, CASE WHEN kind IN (0, 1) THEN a || '.5 ' || b ELSE '' END AS quantities FROM o""")
def uncertain_values(spark: SparkSession, d: str) -> DataFrame:
    """Values in millimetres with their uncertainty; the other clauses have another unit, or none of their own."""
    a, b, kind = F.concat(F.col("o_custkey") % 90, F.lit(".5")), 1 + F.col("o_orderkey") % 9, F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("grew "), a, F.lit(" ± "), b, F.lit(" mm.")))
        .when(kind == 1, F.concat(F.lit("grew "), a, F.lit("mm of ice (SD = "), b, F.lit(")")))
        .when(kind == 2, F.concat(a, F.lit(" +/- "), b, F.lit(" mmol")))
        .when(kind == 3, F.concat(a, F.lit(" mm, "), b, F.lit(" m")))
    )
    found = F.coalesce(J.uncertain_quantities(text, F.lit("mm")), F.array().cast("array<decimal(38,12)>"))
    plain = F.transform(found, lambda n: F.regexp_replace(n.cast("string"), r"\.?0+$", ""))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(plain, " ").alias("quantities"))
