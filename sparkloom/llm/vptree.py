"""Nearest neighbours by largest inner product with a vantage-point tree for each shard.

Vectors x become points (x, sqrt(M^2 - |x|^2)) with M the largest norm, queries (q, 0); the nearest points are then
those with the largest inner products. The top levels of one vantage-point tree, fitted on a bounded sample, cut the
points into regions, a hash cuts large regions into shards of about shard_rows, and each shard has a tree of its own. A
query first asks one shard of the region it falls into; its k-th nearest there bounds what it must still ask: shards
and subtrees whose distance, by the triangle inequality, is beyond that bound divided by `factor` are skipped. Factor one
is exact, larger ones skip more. Scores are sums of products of the original components in double precision, and of
equal scores the smaller vec_id wins, in every leaf and at the end.

Of equal vectors only the k + 1 smallest vec_ids can be among the k nearest of any query, so the others go before any
vector is sent to a shard, and equal queries are asked once.

Null, empty and zero vectors, those with null or non-finite components and rows without a vec_id take no part. Vectors
of different lengths have no inner product: each length is searched by itself. Rows that repeat a vec_id are candidates
of their own; of rows that repeat a vec_id and its vector one asks, and the others are among its candidates. Queries
without other vectors have no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, small_batches

#: rep: the smallest vec_id that asks for a vector, and the vector's hash
FOUND = "rep string, vec_id long, same boolean, score double"
LEAF = 128
#: Of squared lengths: what sums of products may be off by.
SLACK = 1e-12


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Points on a sphere of radius largest, by one more component."""
    return np.concatenate([x, np.sqrt(np.maximum(0, largest**2 - squares(x)))[:, None]], axis=1)


def distances(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(points - x))


def vantage(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The one of some points whose distances to the others vary most."""
    some = points if len(points) <= 2_000 else points[rng.choice(len(points), 2_000, replace=False)]
    tried = some[rng.choice(len(some), min(8, len(some)), replace=False)]
    return tried[int(np.argmax([np.var(distances(some, v)) for v in tried]))]


class Regions:
    """The top levels of a vantage-point tree over a sample of points: its leaves are regions of the whole space."""

    def __init__(self, points: np.ndarray, regions: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (vantage, middle distance, inner and outer child) or (region,)
        self.size = 0

        def build(own: np.ndarray, most: int) -> int:
            at = len(self.nodes)
            self.nodes.append((self.size,))
            if most > 1 and len(own) > 1:
                v = vantage(own, rng)
                d = distances(own, v)
                middle = float(np.median(d))
                if d.min() <= middle < d.max():
                    self.nodes[at] = (v, middle, build(own[d <= middle], most // 2), build(own[d > middle], most - most // 2))
                    return at
            self.size += 1
            return at

        build(points, regions)

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The region of each point."""
        out = np.zeros(len(points), np.int64)

        def go(at: int, who: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 1:
                out[who] = node[0]
            elif len(who):
                inner = distances(points[who], node[0]) <= node[1]
                go(node[2], who[inner])
                go(node[3], who[~inner])

        go(0, np.arange(len(points)))
        return out

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What each region is away from each query, at least."""
        out = np.zeros((len(queries), self.size))

        def go(at: int, least: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 1:
                out[:, node[0]] = least
            else:
                beyond = distances(queries, node[0]) - node[1]
                go(node[2], np.maximum(least, beyond))
                go(node[3], np.maximum(least, -beyond))

        go(0, np.zeros(len(queries)))
        return out


class VantageTree:
    """Over vectors x with ids; leaves are ranges of `order`."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, largest: float, leaf: int = LEAF, seed: int = 7):
        self.ids, self.x, self.points, self.leaf = ids, x, lifted(x, largest), leaf
        self.largest = largest
        self.order = np.arange(len(x))
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self._build(0, len(x))

    def _build(self, a: int, b: int) -> int:
        """(vantage, inner and outer bounds, children) or a leaf's (None, a, b)."""
        at = len(self.nodes)
        self.nodes.append((None, a, b))
        if b - a <= self.leaf:
            return at
        own = self.order[a:b]
        v = vantage(self.points[own], self.rng)
        d = distances(self.points[own], v)
        by = np.argsort(d, kind="stable")
        d = d[by]
        if d[0] == d[-1]:
            return at
        self.order[a:b] = own[by]
        half = (b - a) // 2
        bounds = (d[0], d[half - 1]), (d[half], d[-1])
        self.nodes[at] = (v, bounds, (self._build(a, a + half), self._build(a + half, b)))
        return at

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows of each query, by score, then id; known: scores that must be reached."""
        nq = len(queries)
        self.queries, self.lengths = queries, squares(queries)
        self.lifted = np.concatenate([queries, np.zeros((nq, 1))], axis=1)
        self.score, self.rows = np.full((nq, k), -np.inf), np.full((nq, k), -1)
        self.floor = np.full(nq, -np.inf) if known is None else known
        self.slack = SLACK * len(queries[0]) * (self.largest**2 + self.lengths) if nq else np.zeros(0)
        home = np.full(nq, -1)
        if known is None:
            self._seed(0, np.arange(nq), home)
        self._visit(0, np.arange(nq), home, factor)
        q, at = np.nonzero(self.rows >= 0)
        return q, self.rows[q, at], self.score[q, at]

    def _reach(self, who: np.ndarray) -> np.ndarray:
        """Scores below which nothing counts for these queries."""
        return np.maximum(self.score[who, -1], self.floor[who])

    def _seed(self, at: int, who: np.ndarray, home: np.ndarray) -> None:
        if not len(who):
            return
        node = self.nodes[at]
        if node[0] is None:
            home[who] = at
            self._leaf(node, who)
            return
        v, ((_, inner), (outer, _)), children = node
        near = distances(self.lifted[who], v) <= (inner + outer) / 2
        self._seed(children[0], who[near], home)
        self._seed(children[1], who[~near], home)

    def _visit(self, at: int, who: np.ndarray, home: np.ndarray, factor: float) -> None:
        node = self.nodes[at]
        if node[0] is None:
            who = who[home[who] != at]
            if len(who):
                self._leaf(node, who)
            return
        v, bounds, children = node
        d = distances(self.lifted[who], v)
        for (low, high), child in zip(bounds, children):
            beyond = factor * np.maximum(0, np.maximum(low - d, d - high))
            # |p - q|^2 = M^2 + |q|^2 - 2 p.q
            farthest = self.largest**2 + self.lengths[who] - 2 * self._reach(who)
            go = beyond**2 <= farthest + 2 * self.slack[who]
            if go.any():
                self._visit(child, who[go], home, factor)

    def _leaf(self, node: tuple, who: np.ndarray) -> None:
        k = self.rows.shape[1]
        for s in range(node[1], node[2], 1024):
            own = self.order[s : min(s + 1024, node[2])]
            about = self.queries[who] @ self.x[own].T
            q, p = np.nonzero(about >= (self._reach(who) - self.slack[who])[:, None])
            if not len(q):
                continue
            rows = own[p]
            exact = np.concatenate([np.einsum("ij,ij->i", self.queries[who[q[i : i + 20_000]]], self.x[rows[i : i + 20_000]]) for i in range(0, len(q), 20_000)])
            hit = np.unique(q)
            old, at = np.nonzero(self.rows[who[hit]] >= 0)
            q = np.concatenate([q, hit[old]])
            rows = np.concatenate([rows, self.rows[who[hit[old]], at]])
            exact = np.concatenate([exact, self.score[who[hit[old]], at]])
            order = np.lexsort((self.ids[rows], -exact, q))
            q, rows, exact = q[order], rows[order], exact[order]
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
            top = place < k
            self.rows[who[hit]], self.score[who[hit]] = -1, -np.inf
            self.rows[who[q[top]], place[top]], self.score[who[q[top]], place[top]] = rows[top], exact[top]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1) if len(whole) else np.zeros((0, 1))


def search_shard(vectors: pa.Table, queries: pa.Table, k: int, factor: float, largest: float) -> pa.Table:
    """The k best of a shard's vectors for each query (rep, v, least: a score to reach or null), its own row included."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    if not len(vectors) or not len(queries):
        return pa.Table.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.bool_(), pa.float64())], names)
    ids, x = vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v"))
    reps, q = queries.column("rep").combine_chunks(), _matrix(queries.column("v"))
    least = queries.column("least").to_numpy().astype(np.float64)
    known = None if np.isnan(least).all() else np.where(np.isnan(least), -np.inf, least)
    who, rows, score = VantageTree(ids, x, largest).search(q, k, factor, known)
    same = (x[rows] == q[who]).all(axis=1)
    return pa.Table.from_arrays([reps.take(pa.array(who)), pa.array(ids[rows]), pa.array(same), pa.array(score)], names)


def nearest(vectors: DataFrame, queries, k: int = 20, factor: float = 1.5, shard_rows: int = 8_192, block_rows: int = 4_096, sample_rows: int = 20_000, most_regions: int = 1_024) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors (vec_id, embedding) of each row for which `queries` (a condition) holds."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    valid = vectors.select("vec_id", v.alias("v"), F.size(v).alias("dim"), F.coalesce(queries, F.lit(False)).alias("is_query")).filter(v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))

    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    spaces = {r["dim"]: (r["n"], float(r["m"]) ** 0.5 * (1 + 1e-9)) for r in valid.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("m")).collect()}  # one row for each length
    total = sum(n for n, _ in spaces.values())
    share = min(1.0, sample_rows / max(1, total))
    sample: dict[int, list] = {dim: [] for dim in spaces}
    for r in valid.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1e6 * share)).select("dim", "v").limit(2 * sample_rows).collect():
        sample[r["dim"]].append(r["v"])
    regions = {dim: Regions(lifted(np.array(sample[dim], np.float64).reshape(-1, dim), largest), min(most_regions, 1 + n // shard_rows)) for dim, (n, largest) in spaces.items()}
    tree = spark.sparkContext.broadcast((regions, {dim: m for dim, (_, m) in spaces.items()}))

    def home(batches):
        own, largest = tree.value
        for batch in batches:
            region = np.zeros(batch.num_rows, np.int64)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                region[at] = own[dim].homes(lifted(_matrix(batch.column("v").take(pa.array(at))), largest[dim]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region.astype(np.int32))], [*batch.schema.names, "region"])

    kind = dict(valid.dtypes)["v"]
    smallest = Window.partitionBy("v").orderBy("vec_id")
    candidates = valid.withColumn("r", F.row_number().over(smallest)).filter(F.col("r") <= k + 1).select("vec_id", "v", "dim")
    placed = Scratch(candidates.mapInArrow(home, f"vec_id long, v {kind}, dim int, region int")).read()
    counts = placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))  # a row for each region: most_regions for each length
    shard = F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard")
    dealt = placed.join(F.broadcast(counts), ["dim", "region"]).select("vec_id", "v", "dim", "region", shard)

    asked = valid.filter("is_query").select("vec_id", "v", "dim").distinct()
    # grouped by more than the vector, so that the join with its rows deals both sides itself and can split them
    reps = asked.groupBy("v", "dim", F.xxhash64("v").alias("dealt")).agg(F.min("vec_id").alias("least")).select("v", "dim", F.concat_ws(":", "least", "dealt").alias("rep"))
    ask = Scratch(reps.select("rep", "v", "dim").mapInArrow(home, f"rep string, v {kind}, dim int, region int").join(F.broadcast(counts), ["dim", "region"], "left"))

    def meet(asking: DataFrame, name: str) -> DataFrame:
        """Searches of (rep, v, dim, region, shard, least); a shard is sent once for each block of its queries."""
        per_shard = asking.groupBy("dim", "region", "shard").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
        given = dealt.join(per_shard, ["dim", "region", "shard"]).select("dim", "region", "shard", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), "vec_id", "v")
        blocked = asking.join(per_shard, ["dim", "region", "shard"]).select("dim", "region", "shard", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", "v", "least")
        keys = ["dim", "region", "shard", "block"]

        def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            return search_shard(a, b, k + 1, factor, tree.value[1][key[0].as_py()])

        return Scratch(given.groupBy(*keys).cogroup(blocked.groupBy(*keys)).applyInArrow(run, FOUND)).read()

    # regions that hold no candidate but that queries fall into have no shard: their queries ask elsewhere
    at_home = ask.read().filter(F.col("shards").isNotNull()).select("rep", "v", "dim", "region", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int").alias("shard"), F.lit(None).cast("double").alias("least"))
    first = meet(at_home, "home")
    reached = first.groupBy("rep").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))

    def elsewhere(batches):
        own, largest = tree.value
        for batch in batches:
            dims, q, least = batch.column("dim").to_numpy(), batch.column("v"), batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            near: list[list[int]] = [[] for _ in dims]
            for dim in np.unique(dims).tolist():
                for at in np.array_split(np.flatnonzero(dims == dim), 1 + len(dims) // 1_000):
                    x = _matrix(q.take(pa.array(at)))
                    far = largest[dim] ** 2 + squares(x) - 2 * np.where(np.isnan(least[at]), -np.inf, least[at])
                    bound = own[dim].bounds(np.concatenate([x, np.zeros((len(x), 1))], axis=1))
                    slack = 4 * SLACK * dim * (largest[dim] ** 2 + squares(x))
                    go = np.square(factor * bound) <= (far + slack)[:, None]
                    for i, row in zip(at.tolist(), go):
                        near[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "v", "dim", "least")), pa.array(near, pa.list_(pa.int32()))], ["rep", "v", "dim", "least", "near"])

    met = ask.read().join(reached, "rep", "left").select("rep", "v", "dim", "least").mapInArrow(elsewhere, f"rep string, v {kind}, dim int, least double, near array<int>")
    rest = met.withColumn("region", F.explode("near")).join(F.broadcast(counts), ["dim", "region"]).withColumn("shard", F.explode(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int"))))
    rest = rest.join(at_home.select("rep", "dim", "region", "shard"), ["rep", "dim", "region", "shard"], "left_anti")
    second = meet(Scratch(rest.select("rep", "v", "dim", "region", "shard", "least")).read(), "rest")

    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    found = first.union(second).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    mine = asked.join(reps.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep")
    lists = found.groupBy("rep").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "same", "score")).alias("l"))  # k + 1 at most
    lists = mine.join(lists, "rep").select("query_id", F.array_sort("l").alias("l"))
    is_own = F.transform("l", lambda e: e["same"] & (e["vec_id"] == F.col("query_id")))
    own_at = F.coalesce(F.nullif(F.array_position(is_own, True), F.lit(0)), F.lit(k + 2))  # only one row is the query's own
    others = F.slice(F.filter("l", lambda e, i: i + 1 != own_at), 1, k)
    out = lists.select("query_id", F.posexplode(others).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
