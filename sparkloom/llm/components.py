"""Connected components of a table of edges, by alternating star contractions.

Tasks first contract their own edges, so hubs shrink before any shuffle. Each round then points every node's larger
neighbours to the smallest one (large star) and its smaller neighbours likewise (small star), until nothing changes;
the edges left are stars. The smallest neighbour of a node is grouped by more than the node, so that the join with its
edges deals both sides itself and adaptive execution can split a hub's. Rounds are cut by checkpoint() in the shared
folder. Only a count and a sum reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import scratch_root


class Stars:
    """Contracts edges as they come: what is left joins what they joined."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def _find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def add(self, a: list[int], b: list[int]) -> None:
        for x, y in zip(a, b):
            rx, ry = self._find(x), self._find(y)
            if rx != ry:
                self.parent[max(rx, ry)] = min(rx, ry)

    def batch(self) -> pa.RecordBatch:
        """Edges (node, smallest node of its component); none are held afterwards."""
        nodes = list(self.parent)
        roots = [self._find(x) for x in nodes]
        self.parent = {}
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def contracted(edges: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Star edges, for a task that makes its edges itself; at most so many nodes are held."""
    stars = Stars()
    for a, b in edges:
        stars.add(a.tolist(), b.tolist())
        if len(stars.parent) > most:
            yield stars.batch()
    yield stars.batch()


def contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return contracted((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour m of each node u, or the node itself where that is smaller."""
    return edges.groupBy("u", F.xxhash64("u").alias("dealt")).agg(F.least(F.min("v"), F.col("u")).alias("m")).select("u", "m")


def connected_components(edges: DataFrame, max_rounds: int = 40, stars_already: bool = False) -> DataFrame:
    """node, component (its smallest node) of every node in edges (a, b); edges of a node with itself do not count.
    stars_already: the tasks that made the edges have contracted them."""
    scratch_root(edges.sparkSession)
    stars = edges.select("a", "b").filter("a <> b")
    stars = (stars if stars_already else stars.mapInArrow(contract_batches, "a long, b long")).toDF("u", "v").checkpoint()
    seen = None
    for _ in range(max_rounds):
        both = stars.union(stars.select("v", "u"))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        stars = small.checkpoint()
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(stars.select("v", "v")).distinct()
