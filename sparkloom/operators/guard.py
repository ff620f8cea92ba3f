"""Decisions on papers by their criteria, and what a run will still cost and which model it should pause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.prefilter import strings

# The criteria of a paper and the statuses that meet them.
CRITERIA = ("published_primary_findings", "stable_identity_version", "study_geography", "access_rights_evidence", "correction_retraction_coverage")
REQUIRED = ("published_primary_findings", "stable_identity_version", "study_geography", "access_rights_evidence")
GEOGRAPHY = "study_geography"
CORRECTION = "correction_retraction_coverage"
CORRECTION_MET = ("satisfied", "uncertain")

#: Money has six places. Ratios of money are rounded to them half to even.
MONEY = "decimal(18,6)"


def _names(of: tuple[str, ...], holds) -> Column:
    """Those of the names for which the condition holds, in order."""
    return F.array_compact(F.array(*[F.when(holds(n), F.lit(n)) for n in sorted(of)]))


def _status(statuses: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(statuses, F.lit(name)), F.lit(""))


def unsatisfied(statuses: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Criteria that bar a paper, sorted: required ones not satisfied, and a correction neither covered nor uncertain.
    statuses maps criteria to statuses; an absent or null status, or a null map, satisfies nothing."""
    bars = lambda n: ~_status(statuses, n).isin(*CORRECTION_MET) if n == CORRECTION else _status(statuses, n) != "satisfied"
    return _names(tuple(n for n in (*REQUIRED, CORRECTION) if n == CORRECTION or n not in ignored), bars)


def rescreen_eligible(statuses: Column) -> Column:
    """Whether an uncertain geography is all that bars a paper."""
    return (_status(statuses, GEOGRAPHY) == "uncertain") & (F.size(unsatisfied(statuses, (GEOGRAPHY,))) == 0)


def decision(statuses: Column) -> Column:
    """excluded by any failed criterion, else eligible or uncertain, with the reasons."""
    failed, open_ = _names(CRITERIA, lambda n: _status(statuses, n) == "failed"), unsatisfied(statuses)
    reasons = lambda kind, names: F.transform(names, lambda n: F.concat(F.lit(f"criterion_{kind}:"), n))
    row = lambda d, r: F.struct(F.lit(d).alias("decision"), r.alias("reasons"))
    return (
        F.when(F.size(failed) > 0, row("excluded", reasons("failed", failed)))
        .when(F.size(open_) == 0, row("eligible", strings("all_required_criteria_satisfied")))
        .otherwise(row("uncertain", reasons("unresolved", open_)))
    )


def _at_least_zero(number: Column) -> Column:
    return F.greatest(F.coalesce(number, F.lit(0)).cast("long"), F.lit(0).cast("long"))


def _ratio(money: Column, by: Column) -> Column:
    """Money over a count; null over zero."""
    return F.when(by > 0, F.bround(money / by.cast("decimal(10,0)"), 6).cast(MONEY))


def expected_questions(accepted: Column, allocation: Column, spent: Column, evaluated: Column, target: Column) -> dict[str, Column]:
    """How many questions a run will still bring: those accepted, and as many more as the rest of its money pays at its own
    cost of each, or its target (null or 0: none) where that is less. Nulls and negative counts are 0; with nothing
    accepted or spent, nothing more is expected."""
    accepted, evaluated = _at_least_zero(accepted), _at_least_zero(evaluated)
    allocation, spent = (F.coalesce(x, F.lit(0)).cast(MONEY) for x in (allocation, spent))
    left = F.greatest(allocation - spent, F.lit(0).cast(MONEY))
    micro = lambda x: (x * F.lit(1_000_000)).cast("decimal(26,0)")
    pays = (micro(left) * accepted.cast("decimal(10,0)")).cast("decimal(38,0)")
    further = F.when((accepted > 0) & (spent > 0), F.call_function("div", pays, micro(spent))).otherwise(F.lit(0)).cast("long")
    by_money, by_target = accepted + further, F.coalesce(target, F.lit(0)).cast("long")
    bound = (by_target > 0) & (by_target < by_money)
    total = F.when(bound, F.greatest(by_target, accepted)).otherwise(by_money)
    return {
        "remaining_usd": left.cast(MONEY),
        "usd_per_accepted": _ratio(spent, accepted),
        "further_accepted": further,
        "binding_bound": F.when(bound, "accepted_question_target").otherwise("allocation"),
        "expected_total": total,
        "still_expected": F.greatest(total - evaluated, F.lit(0).cast("long")),
    }


def extrapolated(spent: Column, evaluated: Column, still: Column) -> dict[str, Column]:
    """Cost of a question, and of all of them at that cost; null if none has been evaluated."""
    evaluated, still = _at_least_zero(evaluated), _at_least_zero(still)
    spent = F.coalesce(spent, F.lit(0)).cast(MONEY)
    total = spent * (evaluated + still).cast("decimal(10,0)") / evaluated.cast("decimal(10,0)")
    return {"usd_per_question": _ratio(spent, evaluated), "extrapolated_usd": F.when(evaluated > 0, F.bround(total, 6).cast(MONEY))}


def pause_choice(readings: DataFrame) -> DataFrame:
    """Of each vendor's models that aren't paused the one that costs most a question, ties by name, those without a cost
    last; a vendor with no such model has no row. readings: vendor, model, usd_per_question, paused (null: not paused).
    One aggregation with partial results, no sort."""
    cost = F.col("usd_per_question")
    order = F.struct(cost.isNull().alias("unknown"), (-F.coalesce(cost, F.lit(0))).alias("cost"), F.col("model"))
    open_ = readings.filter(~F.coalesce("paused", F.lit(False)) & F.col("model").isNotNull())
    return open_.groupBy("vendor").agg(F.min(order).alias("first")).select("vendor", F.col("first.model").alias("model"))
