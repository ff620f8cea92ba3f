"""Scores of trials with and without the right answer among the options: counts, rates, shifts, strata, pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("N0", "N1", "N2", "N3", "N4", "N5")


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is null or zero."""
    return a.cast("double") / F.when(b != 0, b).cast("double")


def counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == n).alias(n.lower()) for n in OUTCOMES]


def tally(trials: DataFrame, *keys: str) -> DataFrame:
    """Outcomes counted per group; absent ones count zero."""
    return trials.groupBy(*keys).agg(*counts())


def metrics() -> dict[str, Column]:
    """Expressions over n1..n5: the one place where the formulas stand."""
    n1, n2, n3, n4, n5 = (F.col(n.lower()) for n in OUTCOMES[1:])
    total = n1 + n2 + n3 + n4 + n5
    precision, recall = ratio(n5, n3 + n5), ratio(n5, n2 + n4 + n5)
    return {
        "acc": ratio(n1 + n5, total),
        "precision_abs": precision,
        "recall_abs": recall,
        "f1_abs": F.when(precision + recall != 0, 2 * precision * recall / (precision + recall)),
        "abstention_rate": ratio(n3 + n5, total),
        "r_acc": ratio(n1, n1 + n2 + n4),
        "ssr": ratio(n1 + n3 + n5, total),
        "recall_abs_absent_only": ratio(n5, n4 + n5),
        "present_abstention": ratio(n3, n1 + n2 + n3),
        "absent_abstention": ratio(n5, n4 + n5),
        "shift": ratio(n5, n4 + n5) - ratio(n3, n1 + n2 + n3),
        "accuracy_when_answering": ratio(n1, n1 + n2),
        "gold_rate": ratio(n1, n1 + n2 + n3),
        "false_commitment_rate": ratio(n4, n4 + n5),
    }


def with_metrics(tallied: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    every = metrics()
    return tallied.withColumns({n: F.round(every[n], digits) for n in names or every})


def last_outcomes() -> list[Column]:
    """The outcomes of a question's repeat with and without gold; the last row of a condition counts."""
    return [F.max_by(F.when(F.col("condition") == c, F.col("outcome")), F.when(F.col("condition") == c, F.col("trial_id"))).alias(a) for c, a in (("gold_present", "gp"), ("gold_absent", "ga"))]


def pair_counts() -> list[Column]:
    """Complete pairs (both valid) and those that chose gold when present and abstained when absent, of last outcomes."""
    gp, ga = F.col("gp"), F.col("ga")
    return [F.count_if((gp != "N0") & (ga != "N0")).alias("pairs"), F.count_if((gp == "N1") & (ga == "N5")).alias("ideal")]


def pair_rate(trials: DataFrame, *keys: str) -> DataFrame:
    """Share of complete pairs that are ideal."""
    last = trials.groupBy(*keys, "item_id", "repeat").agg(*last_outcomes())
    whole = last.filter("gp <> 'N0' and ga <> 'N0'")
    return whole.groupBy(*keys).agg(*pair_counts()).withColumn("ideal_pair_rate", F.round(ratio(F.col("ideal"), F.col("pairs")), 6))


def question_counts(trials: DataFrame, *keys: str) -> DataFrame:
    """Outcomes, complete pairs and ideal ones counted per question."""
    repeats = trials.groupBy(*keys, "item_id", "repeat").agg(*counts(), *last_outcomes())
    return repeats.groupBy(*keys, "item_id").agg(*[F.sum(n.lower()).alias(n.lower()) for n in OUTCOMES], *pair_counts())


def letters(trials: DataFrame, *keys: str) -> DataFrame:
    """Chosen letters of valid responses and their shares of the group."""
    n = trials.filter("outcome <> 'N0'").groupBy(*keys, "letter").agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    return n.join(total, list(keys)).withColumn("share", F.round(ratio(F.col("n"), F.col("total")), 4))


def as_abstention(trials: DataFrame) -> DataFrame:
    """Invalid responses count as abstentions."""
    return trials.withColumn("outcome", F.when(F.col("outcome") != "N0", F.col("outcome")).when(F.col("condition") == "gold_present", "N3").otherwise("N5"))


def by_stratum(trials: DataFrame, strata: dict[str, Column], *keys: str) -> DataFrame:
    """One group for each value of each stratum (rows are expanded once, not read once per stratum)."""
    pairs = F.array(*[F.struct(F.lit(name).alias("stratum"), F.coalesce(value.cast("string"), F.lit("None")).alias("value")) for name, value in strata.items()])
    return tally(trials.withColumn("s", F.explode(pairs)).select("*", "s.*"), *keys, "stratum", "value")


def uniform_baseline(present_options: int, absent_options: int) -> dict[str, float]:
    """Expected outcomes of guessing with equal chances, per item and condition."""
    n, m = 1 / present_options, 1 / absent_options
    return {"n1": n, "n2": 1 - 2 * n, "n3": n, "n4": 1 - m, "n5": m}


def question_shift(trials: DataFrame, *keys: str) -> DataFrame:
    """Per question: share of abstentions when absent less that when present; questions without both have no row."""
    valid = trials.filter("outcome <> 'N0'")
    g = valid.groupBy(*keys, "item_id").agg(
        F.count_if(F.expr("condition = 'gold_present'")).alias("p"), F.count_if(F.expr("condition = 'gold_absent'")).alias("a"), F.count_if(F.expr("outcome = 'N3'")).alias("p3"), F.count_if(F.expr("outcome = 'N5'")).alias("a5")
    )
    return g.filter("p > 0 and a > 0").select(*keys, "item_id", (ratio(F.col("a5"), F.col("a")) - ratio(F.col("p3"), F.col("p"))).alias("shift"))


def shift_signs(shifts: DataFrame, *keys: str, tolerance: float = 1e-12) -> DataFrame:
    s = F.col("shift")
    return shifts.groupBy(*keys).agg(
        F.count("*").alias("questions"), F.round(F.avg(s), 6).alias("mean_shift"), F.count_if(s > tolerance).alias("positive"), F.count_if(s < -tolerance).alias("negative"), F.count_if(F.abs(s) <= tolerance).alias("zero")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
