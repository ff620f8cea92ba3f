"""Whitening of embeddings by their leading principal components, found by block Lanczos without a matrix.

Each pass is a Spark job: tasks multiply their centred rows with the block that the driver sends (dimension x block
doubles) and return a partial sum for each dimension; Spark adds them up. The driver keeps the basis only, which has at
most as many vectors as there are dimensions. Every new block is made orthogonal to the whole basis, twice. Columns
that vanish there (an invariant subspace) are replaced by random ones, so the search restarts instead of breaking down.
It ends when the residuals of the components asked for, known from the passes made, are at rounding, or the space is
exhausted. The trace, which explained shares need, is the sum of all rows' squared deviations.

Entries count as fixed-point numbers (scale * c, rounded down, plus offset), so counts, sums and deviations are exact
integers, alike in any order of the rows. Vectors that are null, hold a null or non-finite entry, or one whose
fixed-point number is not exact in a double (2**52 and more), take no part. A shorter vector than the longest counts as
filled up with zeros; so does an empty one. Components without variance (fewer rows or dimensions than components
asked for, constant entries, no rows at all) are left out: whitening has no value there. Repeated rows count as often
as they stand. A deviation that no long can hold is an error by ANSI rules (from about n = 10**5 rows at values spread
by 10**3; `deviation_type` takes decimal(38,0) instead). Ids may be null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest fixed-point number that counts.
EXACT = 2**52


@dataclass(frozen=True)
class Whitening:
    """What rows are whitened with; its size is that of components x dimensions."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int
    scale: int
    offset: int


def usable(vectors: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """The rows that take part."""
    fits = f"forall(`{vec_col}`, c -> c is not null and not isnan(c) and abs(cast(c as double)) < {EXACT // scale // 2}D)"
    return vectors.filter(F.col(vec_col).isNotNull() & F.expr(fits))


def blocks(batches: Iterator[pa.RecordBatch], vec_col: str, d: int, scale: int, offset: int, rows: int = 8_192) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their fixed-point numbers, which of them are given) with zeros' numbers where a vector is short."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            column = part.column(vec_col)
            lengths = np.diff(column.offsets.to_numpy())
            width = max(d, int(lengths.max(initial=0)))
            given = np.arange(width) < lengths[:, None]
            x = np.full((part.num_rows, width), offset, np.int64)
            x[given] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) + offset
            yield part, x, given


def count_and_sum(vectors: DataFrame, vec_col: str, scale: int, offset: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, given_rows = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, x, given in blocks(batches, vec_col, 0, scale, offset):
            n += len(x)
            grow = max(0, x.shape[1] - len(sums))
            sums, given_rows = np.pad(sums, (0, grow)), np.pad(given_rows, (0, grow))
            sums[: x.shape[1]] += np.where(given, x, 0).sum(0)
            given_rows[: x.shape[1]] += given.sum(0)
        dims = pa.array(range(-1, len(sums)), pa.int32())  # -1: the rows
        yield pa.RecordBatch.from_arrays([dims, pa.array([0, *sums.tolist()], pa.int64()), pa.array([n, *given_rows.tolist()], pa.int64())], ["dim", "total", "n"])

    summed = vectors.select(vec_col).mapInArrow(run, "dim int, total long, n long").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    rows = {r["dim"]: r for r in summed.collect()}  # a row for each dimension
    n = rows[-1]["n"] if -1 in rows else 0
    return n, [int(rows[j]["total"]) + (n - rows[j]["n"]) * offset for j in range(len(rows) - 1)]


def centre(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once: the whole numbers n * x - sums come first where a double holds them."""
    if not x.size:
        return np.zeros(x.shape)
    if n * max(abs(int(x.max())), abs(int(x.min()))) < 2**62 and int(np.abs(y := n * x - sums).max(initial=0)) < 2**53:
        return y / n
    q, r = np.divmod(sums, n)  # whole parts first, the remainders are below one
    return (x - q.astype(np.int64)) - (r / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over the dimensions of (n * x - sums)**2, of each row, exactly."""
    if not x.size:
        return [0] * len(x)
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(int(s)) for s in sums)
    if most < 2**62 and (spread := int(np.abs(y := n * x - sums.astype(np.int64)).max())) ** 2 * x.shape[1] < 2**63:
        return (y * y).sum(1).tolist()
    return [sum(v * v for v in row) for row in (n * x.astype(object) - sums)]


def sum_of(vectors: DataFrame, vec_col: str, n: int, sums: list[int], scale: int, offset: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of rows of part(centred rows, deviations), a small matrix: each task adds up its own rows
    and Spark those of the tasks, row by row of the matrix."""
    whole = np.array(sums, dtype=object) if max(map(abs, sums), default=0) >= 2**62 else np.array(sums, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x, _ in blocks(batches, vec_col, len(sums), scale, offset):
            y = part(centre(x, n, whole), np.array([float(v) for v in deviations(x, n, whole)]))
            total = y if total is None else total + y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], ["i", "j", "v"])

    rows = vectors.select(vec_col).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((max(r["i"] for r in rows) + 1, max(r["j"] for r in rows) + 1))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, least: float) -> np.ndarray:
    """As many orthonormal columns as block has, or as the space still holds, orthogonal to basis: those of block, and
    random ones where nothing of more than least is left of it."""
    d, room = block.shape[0], block.shape[0] - basis.shape[1]
    columns: list[np.ndarray] = []
    for k in range(min(block.shape[1], room)):
        v, floor = block[:, k], least
        while True:
            before = np.column_stack([basis, *columns])
            for _ in range(2):  # twice is enough
                v = v - before @ (before.T @ v)
            if (norm := float(np.linalg.norm(v))) > floor:
                v = v / norm
                v = v - before @ (before.T @ v)
                columns.append(v / np.linalg.norm(v))
                break
            v, floor = rng.standard_normal(d), 1e-8
    return np.column_stack(columns) if columns else np.zeros((d, 0))


def lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int, tolerance: float = 1e-14, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, eigenvectors as columns, passes): the k largest of the symmetric matrix that product multiplies
    with. Residuals end it that are tolerance x the largest eigenvalue, about the rounding of the products. A block has k
    columns at least: a smaller one could miss copies of an eigenvalue that is repeated more often than it has columns."""
    rng, block = np.random.default_rng(seed), max(block, k)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    new, passes = orthogonal(rng.standard_normal((d, block)), basis, rng, 1e-8), 0
    while True:
        image = product(new)
        passes += 1
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:k]
        values, vectors = values[top], vectors[:, top]
        ritz = basis @ vectors
        size = max(float(np.abs(values).max(initial=0)), np.finfo(float).tiny)
        residuals = np.linalg.norm(images @ vectors - ritz * values, axis=0)
        if basis.shape[1] == d or len(values) == min(k, d) and residuals.max() <= tolerance * size:
            return values, ritz / np.linalg.norm(ritz, axis=0), passes
        new = orthogonal(image, basis, rng, 1e-12 * size)


def fit(vectors: DataFrame, k: int = 8, vec_col: str = "embedding", scale: int = 1024, offset: int = 100_000, block: int | None = None) -> Whitening:
    """The k leading components of all usable rows. Passes over the table: one for the sums, one for each block (of k
    columns or more), one for the identity's error."""
    rows = usable(vectors, vec_col, scale)
    n, sums = count_and_sum(rows, vec_col, scale, offset)
    d = len(sums)
    if not n or not d:
        return Whitening(n, tuple(sums), np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0, scale, offset)
    traces: list[float] = []

    def product(q: np.ndarray) -> np.ndarray:
        """V q; a row more for the trace."""
        total = sum_of(rows, vec_col, n, sums, scale, offset, lambda c, dev: np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), dev.sum())]))
        traces.append(float(total[-1, 0]) / n**3)
        return total[:-1] / n

    values, components, passes = lanczos(product, d, min(k, d), block or k)
    real = values > 1e-12 * traces[0]
    values, components = values[real], components[:, real]
    error = 0.0
    if len(values):
        w = components / np.sqrt(values)
        error = float(np.abs(sum_of(rows, vec_col, n, sums, scale, offset, lambda c, _: (c @ w).T @ (c @ w)) / n - np.eye(len(values))).max())
    return Whitening(n, tuple(sums), components, values, traces[0], error, passes, scale, offset)


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding", deviation_type: str = "long") -> DataFrame:
    """For each usable row: id_col, n, deviation, and the whitened coordinates as an array."""
    sums = np.array(model.sums, dtype=object) if max(map(abs, model.sums), default=0) >= 2**62 else np.array(model.sums, np.int64)
    w = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, _ in blocks(batches, "v", len(sums), model.scale, model.offset):
            y = centre(x, model.n, sums) @ w
            dev = pa.array([Decimal(v) for v in deviations(x, model.n, sums)], pa.decimal128(38, 0))
            coordinates = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("id"), dev, coordinates], ["id", "deviation", "whitened"])

    rows = usable(vectors, vec_col, model.scale).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    out = rows.mapInArrow(run, "id long, deviation decimal(38,0), whitened array<double>")
    return out.select(F.col("id").alias(id_col), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast(deviation_type).alias("deviation"), "whitened")


def by_component(whitened: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component, with the component's share of the trace."""
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.eigenvalues]) if len(model.eigenvalues) else F.array().cast("array<double>")
    rows = whitened.select(id_col, "n", "deviation", F.posexplode("whitened").alias("k", "value"))
    return rows.select(
        id_col,
        (F.col("k") + 1).alias("component"),
        "n",
        "deviation",
        F.col("value").alias("whitened"),
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
