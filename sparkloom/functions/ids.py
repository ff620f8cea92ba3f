"""Identifiers and orders that follow from content alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """prefix and the start of a SHA-256 of the parts as a JSON array."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, length))


def in_sample(key: Column, share: float) -> Column:
    """Whether a hash of the key falls in the first share of all hashes."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("double") / float(16**12) < share


def seeded_order(values: Column, prefix: str, seed: Column) -> Column:
    """An array in the fixed pseudo-random order that a seed gives."""
    keyed = F.transform(values, lambda x: F.struct(stable_id(prefix, seed, x.cast("string")).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def apply_order(values: Column, order: Column) -> Column:
    """An array by the places of its values in another; values that the order lacks make the result null."""
    placed = F.transform(values, lambda x: F.struct(F.array_position(order, x).alias("p"), x.alias("x")))
    return F.when(~F.exists(placed, lambda s: s["p"] == 0), F.transform(F.array_sort(placed), lambda s: s["x"]))


def letters(n: Column) -> Column:
    return F.substring(F.lit("ABCDEFGHIJ"), F.lit(1), n)


def letter_list(n: int) -> str:
    """A or B; A, B, or C."""
    a = "ABCDEFGHIJ"[:n]
    return f"{a[0]} or {a[1]}" if n == 2 else ", ".join(a[:-1]) + f", or {a[-1]}"
