"""Latest rows, overlays, anti joins, gates, merges: lookups by key without loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in this order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def latest_value(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the largest `by` per key, by aggregation (no sort of the group; hot keys combine before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_x")).select(*keys, "_x.*")


def overlay(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the non-null values of changes (one row per key) in their place."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    joined = base.join(c, key, "left")
    return joined.withColumns({x: F.coalesce(f"_{x}", x) for x in columns}).drop(*[f"_{x}" for x in columns])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: rows of this violate a uniqueness gate."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str, order: Column) -> DataFrame:
    """table and those rows whose key it lacks; of rows with one key the first in order."""
    return table.unionByName(latest(missing(rows, table, key), [key], order))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, with multiplicity; empty if both hold the same."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def must_be_empty(violations: DataFrame, message: str) -> DataFrame:
    """One row with 0, or an error that names the gate."""
    return violations.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.lit(0)).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("n").cast("string")))).alias("violations"))


def islands(df: DataFrame, keys: list[str], low: str, high: str, gap: float) -> DataFrame:
    """Numbers runs of intervals that lie no more than gap from what comes before them; nulls come last. Equal intervals
    share a run: the sum is over peers, so it doesn't depend on their order."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(low), F.asc_nulls_last(high))
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(before.isNull() | (F.col(low) - before > gap), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w).cast("long")).drop("_new")


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, low: str, high: str, width: int) -> DataFrame:
    """points within [low, high) of intervals of their key, met by buckets of a width (an equi-join, no nested loop)."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    i = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return p.join(i, [key, "_b"]).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the latest value of right at or before its time: one window over both, no range join."""
    both = left.withColumn("_l", F.lit(1)).unionByName(right.select(key, at, F.struct(F.col(value).alias("v")).alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, F.col("_l").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)["v"]).filter("_l = 1").drop("_l", "_v")


def positions(df: DataFrame, key: Column, name: str = "position", parts: int | None = None, sample: int | None = None) -> DataFrame:
    """df with the place of each row, from 1, in the order of a key that no two rows share.

    Rows are dealt by ranges of the key, numbered within their range, and moved up by the rows of the ranges before it,
    so no task sorts all rows. There is a range for about each 500,000 rows, 64 to 10,000 of them; the bounds come from a
    sample of about 64 keys for each range and are constants of the plan.
    """
    rows = df.withColumn("key", key)
    n = rows.count()
    parts = parts or min(10_000, max(64, n // 500_000))
    every = max(1, n // (sample or 64 * parts))
    seen = sorted(r[0] for r in rows.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").collect())
    bounds = [seen[len(seen) * i // parts] for i in range(1, parts)] if seen else []
    kind = rows.schema["key"].dataType
    table = df.sparkSession.createDataFrame([(sorted(set(bounds)),)], StructType([StructField("bounds", ArrayType(kind))]))
    placed = rows.crossJoin(F.broadcast(table)).withColumn("range", F.size(F.filter("bounds", lambda b: b <= F.col("key")))).drop("bounds")  # one row
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = placed.groupBy("range").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("range", "offset")
    own = placed.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("key")))
    return own.join(F.broadcast(offsets), "range").withColumn(name, (F.col("place") + F.col("offset")).cast("long")).select(*df.columns, name)
