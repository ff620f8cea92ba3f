"""Ledgers of requests: state sums, costs, replay of a journal on a snapshot, trailing windows and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    """A decimal of scale 6; what isn't a number counts zero."""
    return F.coalesce(x.try_cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))


def state_sums(requests: DataFrame, *keys: str) -> DataFrame:
    """Counts and sums of cost per state, states as columns."""
    states = ("completed", "submitted", "ambiguous_charge")
    aggs = [F.count_if(F.col("state") == s).alias(f"{s}_n") for s in states] + [F.coalesce(F.sum(F.when(F.col("state") == s, F.col("cost"))).cast("double"), F.lit(0.0)).alias(f"{s}_cost") for s in states]
    return requests.groupBy(*keys).agg(F.count("*").alias("requests"), *aggs)


def replay(snapshot: DataFrame, journal: DataFrame, key: str, base: int) -> DataFrame:
    """State after a journal of absolute assignments (seq, key, value; null: removed) on a snapshot (key, value) taken at base.

    Assignments are absolute, so the latest per key wins whatever the order of arrival, and replays change nothing.
    """
    rows = snapshot.select(F.lit(base).cast("long").alias("seq"), key, "value").union(journal.filter(F.col("seq") > base).select("seq", key, "value"))
    return rows.groupBy(key).agg(F.max_by(F.struct("value"), "seq").alias("x")).select(key, "x.value").filter("value is not null")


def trailing_count(events: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Events of the key in the trailing window, the row's own included."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("trailing", F.count("*").over(w))


def sessions(events: DataFrame, keys: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """One row per run of events whose gaps are no longer than gap_seconds."""
    w = Window.partitionBy(*keys).orderBy(ts)
    new = F.when(F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(w).cast("timestamp").cast("double") <= gap_seconds, 0).otherwise(1)
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "session").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count("*").alias("events"))


def idle_rate(samples: DataFrame, keys: list[str], ts: str, level: str, spend: str) -> DataFrame:
    """Drop of a level per second over adjacent samples without spend and without a rise (reset)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = samples.select(*keys, (F.lag(level).over(w) - F.col(level)).alias("drop"), (F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(w).cast("timestamp").cast("double")).alias("seconds"), F.col(spend).alias("spend"))
    ok = d.filter("drop >= 0 and seconds > 0 and spend = 0")
    return ok.groupBy(*keys).agg(F.round(F.sum("drop"), 6).alias("burned"), F.round(F.sum("seconds"), 3).alias("seconds"), F.count("*").alias("pairs"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million tokens."""
    return ((tokens_in.cast("decimal(18,0)") * price_in.cast("decimal(18,6)") + tokens_out.cast("decimal(18,0)") * price_out.cast("decimal(18,6)")) / F.lit(1_000_000)).cast("decimal(18,6)")
