"""Queries of decisions on papers, expected questions and costs, texts within a budget, and extraction reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.adapters import REQUEST, requests, table
from sparkloom.functions import text as T
from sparkloom.operators import guard as G
from sparkloom.operators.prefilter import strings
from sparkloom.plans.registry import query

STATUS_SQL = ", ".join(f"CASE WHEN doc_id % {p} = 0 THEN 'uncertain' WHEN doc_id % {p} = 1 AND doc_id % 3 = 0 THEN 'failed' WHEN doc_id % {p} = 2 AND doc_id % 5 = 0 THEN 'unknown' ELSE 'satisfied' END AS {c}" for c, p in zip(G.CRITERIA, (5, 7, 4, 11, 6), strict=True))
OPEN_SQL = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} <> 'satisfied' THEN '{c}' END" for c in G.REQUIRED) + f", CASE WHEN {G.CORRECTION} NOT IN ('satisfied', 'uncertain') THEN '{G.CORRECTION}' END], lambda x: x IS NOT NULL))"
FAILED_SQL = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} = 'failed' THEN '{c}' END" for c in G.CRITERIA) + "], lambda x: x IS NOT NULL))"


def statuses() -> Column:
    i = F.col("doc_id")

    def status(p: int) -> Column:
        return F.when(i % p == 0, "uncertain").when((i % p == 1) & (i % 3 == 0), "failed").when((i % p == 2) & (i % 5 == 0), "unknown").otherwise("satisfied")

    return F.map_from_arrays(strings(*G.CRITERIA), F.array(*[status(p) for p in (5, 7, 4, 11, 6)]))


@query(f"""WITH s AS (SELECT doc_id, {STATUS_SQL} FROM documents), o AS (SELECT *, {OPEN_SQL} AS open, {FAILED_SQL} AS failed FROM s)
SELECT doc_id, CASE WHEN len(failed) > 0 THEN 'excluded' WHEN len(open) = 0 THEN 'eligible' ELSE 'uncertain' END AS decision,
  CASE WHEN len(failed) > 0 THEN array_to_string(list_transform(failed, lambda x: 'criterion_failed:' || x), ',') WHEN len(open) = 0 THEN 'all_required_criteria_satisfied' ELSE array_to_string(list_transform(open, lambda x: 'criterion_unresolved:' || x), ',') END AS reasons,
  study_geography = 'uncertain' AND open = ['study_geography'] AS rescreen FROM o""")
def eligibility_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by criteria, and papers that one more look at their geography could free; a projection."""
    s = table(spark, d, "documents").select("doc_id", statuses().alias("s"))
    s = s.select("doc_id", G.decision(F.col("s")).alias("x"), G.rescreen_eligible(F.col("s")).alias("rescreen"))
    return s.select("doc_id", "x.decision", F.array_join("x.reasons", ",").alias("reasons"), "rescreen")


def run_counts(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    generated = (F.col("phase") == "generation") & (F.col("state") == "completed")
    return r.groupBy("model").agg(
        F.sum("cost").alias("spent"), F.count_if(generated).alias("accepted"), F.count_if((F.col("phase") == "evaluation") & (F.col("state") == "completed")).alias("evaluated"),
    )


RUN_SQL = """run AS (SELECT model, CAST(sum(cost) * 1000000 AS HUGEINT) AS spent, CAST(count(*) FILTER (WHERE phase = 'generation' AND state = 'completed') AS HUGEINT) AS accepted,
  CAST(count(*) FILTER (WHERE phase = 'evaluation' AND state = 'completed') AS HUGEINT) AS evaluated FROM request GROUP BY model)"""


def even(a: str, b: str) -> str:
    """A quotient of whole numbers, halves to even, as money."""
    return f"CAST(CASE WHEN {b} > 0 THEN ({a}) // {b} + CASE WHEN 2 * (({a}) % {b}) > {b} OR 2 * (({a}) % {b}) = {b} AND (({a}) // {b}) % 2 = 1 THEN 1 ELSE 0 END END AS DOUBLE) / 1000000"


ALLOCATION = 100_000_000


@query(f"""WITH {REQUEST}, {RUN_SQL}, m AS (SELECT *, greatest(CAST({ALLOCATION}000000 AS HUGEINT) - spent, 0) AS rest FROM run),
f AS (SELECT *, CASE WHEN accepted > 0 AND spent > 0 THEN rest * accepted // spent ELSE 0 END AS further FROM m),
t AS (SELECT *, CASE WHEN model IN ('m1', 'm2') THEN 500 ELSE 0 END AS target FROM f),
b AS (SELECT *, target > 0 AND target < accepted + further AS bound FROM t), e AS (SELECT *, CASE WHEN bound THEN greatest(target, accepted) ELSE accepted + further END AS total FROM b)
SELECT model, CAST(rest AS DOUBLE) / 1000000 AS remaining_usd, {even("spent", "accepted")} AS usd_per_accepted, CAST(further AS BIGINT) AS further_accepted,
  CASE WHEN bound THEN 'accepted_question_target' ELSE 'allocation' END AS binding_bound, CAST(total AS BIGINT) AS expected_total, CAST(greatest(total - evaluated, 0) AS BIGINT) AS still_expected FROM e""")
def expected_questions(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("model").isin("m1", "m2"), 500).otherwise(0)
    out = G.expected_questions(F.col("accepted"), F.lit(ALLOCATION), F.col("spent"), F.col("evaluated"), target)
    return run_counts(spark, d).select("model", *[(c.cast("double") if n.endswith("usd") or n.startswith("usd") else c).alias(n) for n, c in out.items()])


@query(f"""WITH {REQUEST}, {RUN_SQL} SELECT model, {even("spent", "evaluated")} AS usd_per_question, {even("spent * (evaluated + 250)", "evaluated")} AS extrapolated_usd FROM run""")
def extrapolated_spend(spark: SparkSession, d: str) -> DataFrame:
    out = G.extrapolated(F.col("spent"), F.col("evaluated"), F.lit(250))
    return run_counts(spark, d).select("model", *[c.cast("double").alias(n) for n, c in out.items()])


@query(f"""WITH {REQUEST}, {RUN_SQL}, v AS (SELECT CASE WHEN model IN ('m0', 'm1', 'm2') THEN 'a' WHEN model = 'm3' THEN 'c' ELSE 'b' END AS vendor, model, {even("spent", "CASE WHEN model = 'm5' THEN 0 ELSE evaluated END")} AS cost FROM run WHERE model NOT IN ('m0', 'm3'))
SELECT vendor, model FROM v QUALIFY row_number() OVER (PARTITION BY vendor ORDER BY cost IS NULL, cost DESC, model) = 1""")
def pause_choices(spark: SparkSession, d: str) -> DataFrame:
    """The model that each vendor should pause next; m0 and m3 are paused, m5 has no cost yet."""
    m = F.col("model")
    vendor = F.when(m.isin("m0", "m1", "m2"), "a").when(m == "m3", "c").otherwise("b")
    cost = G.extrapolated(F.col("spent"), F.when(m == "m5", 0).otherwise(F.col("evaluated")), F.lit(0))["usd_per_question"]
    return G.pause_choice(run_counts(spark, d).select(vendor.alias("vendor"), "model", cost.alias("usd_per_question"), m.isin("m0", "m3").alias("paused")))


TOKENS = 300
HEADING = r"(?ims)\A(.*)^[^\S\n]{0,60}(?:[0-9]+[.)]?[^\S\n]{1,6})?(?:references|bibliography|literature cited|works cited)[^\S\n]*:?[^\S\n]*$"


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '5. References:' || chr(10) || '[1] A list.' WHEN doc_id % 3 = 1 THEN 'References' || chr(10) || text ELSE text END AS text FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, length(text) AS n, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS wide, length(regexp_extract(text, '{HEADING}', 1)) AS before FROM t),
e AS (SELECT *, CAST(floor((n - wide) / 4 + wide / 1.5) AS BIGINT) AS tokens, CASE WHEN before > 0 AND before >= n // 2 THEN before ELSE n END AS stop FROM n),
b AS (SELECT *, greatest(1000, CAST(floor({TOKENS} * CASE WHEN tokens > 0 THEN n / tokens ELSE 4.0 END) AS BIGINT)) AS budget FROM e), h AS (SELECT *, budget * 6 // 10 AS head FROM b)
SELECT doc_id, CASE WHEN n <= budget THEN 'whole' WHEN stop <= budget THEN 'references_trimmed' WHEN stop = n THEN 'head_tail' ELSE 'references_trimmed_head_tail' END AS rule,
  sha256(CASE WHEN n <= budget THEN text WHEN stop <= budget THEN substr(text, 1, stop) ELSE substr(text, 1, head) || {"chr(10) || chr(10)"} || '[... middle of the article omitted by the prescreen budget ...]' || {"chr(10) || chr(10)"} || substr(text, stop - (budget - head) + 1, budget - head) END) AS digest FROM h""")
def state_texts(spark: SparkSession, d: str) -> DataFrame:
    """What of each text fits a budget of tokens; some texts end in references, some only begin with the word."""
    i, text = F.col("doc_id"), F.col("text")
    listed = F.when(i % 3 == 0, F.concat(text, F.lit("\n5. References:\n[1] A list."))).when(i % 3 == 1, F.concat(F.lit("References\n"), text)).otherwise(text)
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", T.state_text(listed, TOKENS).alias("x"))
    return t.select("doc_id", "x.rule", F.sha2("x.state", 256).alias("digest"))


def measured(name: str) -> str:
    return f"""len(list_filter(string_split({name}, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS {name}_lines, len(list_filter(string_split({name}, chr(10)), lambda x: regexp_matches(x, '{T.GUTTER}'))) AS {name}_gutters,
  len(regexp_extract_all({name}, '[a-zA-Z]-\\n[a-z]')) AS {name}_breaks, len(regexp_extract_all({name}, '\\S+')) AS {name}_words, length({name}) AS {name}_characters"""


@query(f"""WITH t AS (SELECT doc_id, source, text AS new, regexp_replace(CASE WHEN doc_id % 4 = 0 THEN replace(text, ' w', '    w') ELSE text END, 'e([a-z])', 'e-' || chr(10) || '\\1', 'g') AS old FROM documents WHERE regexp_matches(text, '^[\\x0A\\x20-\\x7E]*$')),
m AS (SELECT doc_id, source, {measured("old")}, {measured("new")} FROM t), r AS (SELECT *, new_words / greatest(1, old_words) AS kept FROM m)
SELECT source, CAST(count(*) AS BIGINT) AS documents, median(kept) AS median_kept, min(kept) AS least_kept, CAST(count(*) FILTER (WHERE kept < 0.9) AS BIGINT) AS below_nine_tenths,
  CAST(sum(old_gutters) AS BIGINT) AS old_gutters, CAST(sum(new_gutters) AS BIGINT) AS new_gutters, CAST(sum(old_breaks) AS BIGINT) AS old_breaks, CAST(sum(new_breaks) AS BIGINT) AS new_breaks, CAST(sum(old_lines) AS BIGINT) AS old_lines, CAST(sum(new_lines) AS BIGINT) AS new_lines FROM r GROUP BY source""")
def extraction_report(spark: SparkSession, d: str) -> DataFrame:
    """Defects of one extraction of texts beside another, and the share of words that the other keeps."""
    text = F.col("text")
    glued = F.when(F.col("doc_id") % 4 == 0, F.replace(text, F.lit(" w"), F.lit("    w"))).otherwise(text)
    t = table(spark, d, "documents").filter(text.rlike(r"\A[\x0A\x20-\x7E]*\z")).select("source", text.alias("new"), F.regexp_replace(glued, "e([a-z])", "e-\n$1").alias("old"))
    m = t.select("source", *[F.struct(*[c.alias(n) for n, c in T.extraction_measures(F.col(x)).items()]).alias(x) for x in ("old", "new")])
    m = m.withColumn("kept", F.col("new.words") / F.greatest(F.lit(1), F.col("old.words")))
    sums = [F.sum(f"{x}.{of}").alias(f"{x}_{n}") for n, of in (("gutters", "gutter_lines"), ("breaks", "mid_word_breaks"), ("lines", "lines")) for x in ("old", "new")]
    return m.groupBy("source").agg(F.count("*").alias("documents"), F.median("kept").alias("median_kept"), F.min("kept").alias("least_kept"), F.count_if(F.col("kept") < 0.9).alias("below_nine_tenths"), *sums)
