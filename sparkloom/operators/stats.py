"""Resampling statistics with the draws of Python's generator, multiplicity correction, AUC."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.scoring import OUTCOMES, metrics, question_counts, ratio, tally

SEED = 7


#: Questions that one group may have: its counts are an array in one row.
MOST_QUESTIONS = 2_000_000


def words_from(seed: int) -> np.random.MT19937:
    """The stream of 32-bit words of random.Random(seed)."""
    key = random.Random(seed).getstate()[1]
    generator = np.random.MT19937()
    generator.state = {"bit_generator": "MT19937", "state": {"key": np.array(key[:-1], np.uint32), "pos": key[-1]}}
    return generator


#: What a task gets of a group's block of resamples, besides the group: state of the generator, kinds and their counts.
BLOCK = {"rounds": "long", "skip": "long", "state": "binary", "kinds": "binary", "counts": "binary"}

#: Words taken from a generator at a time; few, so that they stay in a core's cache.
WORDS = 1 << 16


def state_of(generator: np.random.MT19937) -> bytes:
    """Where a generator stands, as 625 numbers of 32 bits."""
    state = generator.state["state"]
    return state["key"].astype("<u4").tobytes() + np.array([state["pos"]], "<u4").tobytes()


def words_at(state: bytes) -> np.random.MT19937:
    """A generator that goes on from a state."""
    numbers = np.frombuffer(state, "<u4")
    generator = np.random.MT19937()
    generator.state = {"bit_generator": "MT19937", "state": {"key": numbers[:-1].astype(np.uint32), "pos": int(numbers[-1])}}
    return generator


def block_starts(n: int, resamples: int, rounds: int, seed: int = SEED) -> Iterator[tuple[int, bytes, int]]:
    """(first resample, state, draws to leave out after it) of each block of so many rounds, one choice of n places per place.

    A choice takes the upper bits of a word and, where they are no place, those of the next word, so where a resample
    begins is known only by going through those before it: once for all blocks, without drawing.
    """
    generator, bound = words_from(seed), np.uint64(n << (32 - n.bit_length()))
    seen, first = 0, 0
    while first < resamples:
        state = state_of(generator)
        after = seen + int(np.count_nonzero(generator.random_raw(WORDS) < bound))
        while first < resamples and first * n < after:
            yield first, state, first * n - seen
            first += rounds
        seen = after


def drawn_kinds(kinds: np.ndarray, many: int, generator: np.random.MT19937, skip: int, resamples: int, words: int | None = None, once: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Matrices (resample, kind): how often places of each of the kinds 0 to many - 1 are drawn, one choice per place,
    after so many draws that are left out. words: how many are taken at a time. once: a matrix (place, column) whose
    sums over the places drawn at all, each once, stand in columns after the kinds."""
    n, words = len(kinds), words or max(WORDS, many)
    bits = n.bit_length()
    every = np.r_[kinds, np.full((1 << bits) - n, many, kinds.dtype)]  # what is no place is a kind of its own
    own, have = np.zeros(many, np.int64), 0
    seen = np.zeros(1 << bits, np.uint8)
    while resamples:
        places = (generator.random_raw(words) >> np.uint64(32 - bits)).view(np.int64)
        drawn = every[places]
        if not skip:
            found = np.bincount(drawn, minlength=many + 1)
            if have + words - found[many] < n:  # the resample goes on after these words
                own += found[:many]
                have += words - int(found[many])
                if once is not None:
                    seen[places] = 1
                continue
        valid = drawn != many
        drawn = drawn[valid]
        gone = min(skip, len(drawn))
        skip, drawn = skip - gone, drawn[gone:]
        if once is not None:
            places = places[valid][gone:]
        if have + len(drawn) >= n:
            end = n - have
            take = min(resamples - 1, (len(drawn) - end) // n)
            own += np.bincount(drawn[:end], minlength=many)
            more = drawn[end : end + take * n] + np.repeat(np.arange(take) * many, n)
            times = np.vstack([own, np.bincount(more, minlength=take * many).reshape(take, many)])
            if once is not None:
                seen[places[:end]] = 1
                flags = np.zeros((take, n), np.uint8)
                flags.reshape(-1)[places[end : end + take * n] + np.repeat(np.arange(take) * n, n)] = 1
                times = np.hstack([times, np.rint(np.vstack([seen[:n] @ once, flags @ once])).astype(np.int64)])
                seen[:], places = 0, places[end + take * n :]
            yield times
            resamples -= 1 + take
            own, have, drawn = np.zeros(many, np.int64), 0, drawn[end + take * n :]
        own += np.bincount(drawn, minlength=many)
        have += len(drawn)
        if once is not None:
            seen[places] = 1


def drawn_times(n: int, first: int, resamples: int, seed: int = SEED, block: int | None = None) -> Iterator[np.ndarray]:
    """Matrices (resample, place): how often each of n places is drawn, one choice per place, from resample `first` on."""
    yield from drawn_kinds(np.arange(n), n, words_from(seed), first * n, resamples, block)


def sign_matrices(n: int, first: int, permutations: int, seed: int = SEED, block: int = 2_000_000) -> Iterator[np.ndarray]:
    """Matrices (permutation, place) of random signs: +1 where random() < 0.5, two words for each."""
    generator, rows = words_from(seed), max(1, block // n)
    for done in range(0, first * n * 2, 50_000_000):
        generator.random_raw(min(50_000_000, first * n * 2 - done), False)
    for s in range(0, permutations, rows):
        m = min(rows, permutations - s)
        high = generator.random_raw(2 * m * n)[::2] >> np.uint64(31)
        yield 1.0 - 2.0 * high.astype(np.float64).reshape(m, n)


def checked(size: Column) -> Column:
    return F.when(size <= MOST_QUESTIONS, size).otherwise(F.raise_error(F.lit(f"a group has more than {MOST_QUESTIONS} questions")).cast("int"))


def in_blocks(df: DataFrame, rounds: int, blocks: int) -> DataFrame:
    """df with a row for each block of rounds (first, rounds), dealt over the tasks."""
    size = -(-rounds // blocks)
    parts = [F.struct(F.lit(s).alias("first"), F.lit(min(size, rounds - s)).alias("rounds")) for s in range(0, rounds, size)]
    return df.select("*", F.explode(F.array(*parts)).alias("block")).select(*df.columns, "block.*").repartition(blocks * 2)


def bootstrap(trials: DataFrame, key: str, names: list[str] | None = None, resamples: int = 10_000, level: float = 0.95, seed: int = SEED, blocks: int = 16) -> DataFrame:
    """Percentile intervals of metrics (all of them and the rate of ideal pairs, unless named) per group from a paired
    bootstrap of its questions in order of id, and the resamples in which a metric has a value; without any, no interval.

    The counts of a group's questions (at most MOST_QUESTIONS) are arrays. One task goes through a group's random words
    without drawing and says where each block of resamples begins; equal counts are a kind of question. A task then
    takes a group and a block, draws kinds and returns the sums of the counts, so each group and resample is one row.
    A question counts as often as it is drawn, but its pairs once: their keys are the question and the repeat.
    """
    cols, outcomes = [*(n.lower() for n in OUTCOMES), "pairs", "ideal"], len(OUTCOMES)
    grouped = question_counts(trials, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("item_id", *cols))).alias("q"))
    grouped = grouped.select(key, checked(F.size("q")).alias("size"), *[F.col("q")[c].alias(c) for c in cols])
    kind, rounds = dict(trials.dtypes)[key], -(-resamples // blocks)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.stack([batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in cols], 1)
                table, own = np.unique(counts, axis=0, return_inverse=True)
                own, table = own.ravel().astype("<u4").tobytes(), table.astype("<i8").tobytes()
                for first, state, skip in block_starts(len(counts), resamples, rounds, seed):
                    row = [[batch.column(key)[i].as_py()], [min(rounds, resamples - first)], [skip], [state], [own], [table]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [batch.schema.field(key).type, pa.int64(), pa.int64(), *[pa.binary()] * 3])], [key, *BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, left, skip, state, own, table = (column[i].as_py() for column in batch.columns)
                own, table = np.frombuffer(own, "<u4"), np.frombuffer(table, "<i8").reshape(-1, len(cols)).astype(np.float64)
                own, many = own.astype(np.uint16) if len(table) < 1 << 16 else own, len(table)
                drawn = drawn_kinds(own, many, words_at(state), skip, left, once=table[own, outcomes:])
                sums = np.concatenate([np.hstack([np.rint(m[:, :many] @ table[:, :outcomes]).astype(np.int64), m[:, many:]]) for m in drawn])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums), batch.schema.field(key).type), *(pa.array(sums[:, j]) for j in range(len(cols)))], [key, *cols])

    # rows are few and take long, so they are dealt by number
    starts = grouped.repartition(4 * blocks, key).mapInArrow(begin, f"{key} {kind}, " + ", ".join(f"{n} {t}" for n, t in BLOCK.items()))
    sums = starts.repartition(4 * blocks).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} long" for c in cols))
    every = metrics() | {"ideal_pair_rate": ratio(F.col("ideal"), F.col("pairs"))}
    long = sums.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), every[n].alias("v")) for n in names or every])).alias("m")).select(key, "m.*")
    low = (1 - level) / 2
    at = lambda p: F.get("s", F.floor(F.lit(p) * (F.size("s") - 1)).cast("int"))
    values = long.groupBy(key, "metric").agg(F.array_sort(F.collect_list("v")).alias("s"))  # as many as resamples, without nulls
    return values.select(key, "metric", at(low).alias("low"), at(1 - low).alias("high"), F.size("s").cast("long").alias("samples"))


def sign_flip_extremes(differences: list[float], first: int, permutations: int, seed: int = SEED) -> int:
    """Of these permutations those whose mean is as far from zero as the observed one."""
    d = np.array(differences)
    least = abs(sum(differences) / len(d)) - 1e-12
    return sum(int((np.abs(signs @ d / len(d)) >= least).sum()) for signs in sign_matrices(len(d), first, permutations, seed))


def sign_flip_test(shifts: DataFrame, key: str, permutations: int = 20_000, seed: int = SEED, blocks: int = 4) -> DataFrame:
    """Two-sided p-value per group of the mean of its questions' shifts (in order of id, at most MOST_QUESTIONS) when
    signs are random; a task takes a group and a block of permutations."""
    grouped = shifts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("item_id", "shift"))).alias("q"))
    grouped = grouped.select(key, checked(F.size("q")).cast("long").alias("questions"), F.col("q.shift").alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            extremes = [sign_flip_extremes(r["d"], r["first"], r["rounds"], seed) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[key] for r in rows]), pa.array([r["questions"] for r in rows], pa.int64()), pa.array(extremes, pa.int64())], [key, "questions", "extreme"])

    found = in_blocks(grouped, permutations, blocks).mapInArrow(run, f"{key} {dict(shifts.dtypes)[key]}, questions long, extreme long")
    return found.groupBy(key, "questions").agg(((F.sum("extreme") + 1) / F.lit(permutations + 1)).alias("p_value"))


def holm(p_values: DataFrame, order: list[str], p: str = "p_value") -> DataFrame:
    """Step-down adjusted p-values. The rows are hypotheses, so one window over all of them is small."""
    w = Window.orderBy(p, *order)
    n = p_values.agg(F.count("*").alias("hypotheses"))
    ranked = p_values.crossJoin(F.broadcast(n)).withColumn("r", F.row_number().over(w))  # one row
    step = F.least(F.lit(1.0), (F.col("hypotheses") - F.col("r") + 1) * F.col(p))
    return ranked.withColumn("holm", F.max(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("r", "hypotheses")


def auc(scored: DataFrame, score: str, positive: Column, *keys: str) -> DataFrame:
    """Mann-Whitney AUC, ties one half, from counts per distinct score: no pairs are formed."""
    c = scored.groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(w), F.lit(0))
    won = c.withColumn("won", F.col("p") * (below + F.col("n") / 2.0))
    return won.groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("won").alias("w")).withColumn("auc", F.round(ratio(F.col("w"), F.col("positives") * F.col("negatives")), 6)).drop("w")


def custom_statistic(trials: DataFrame, key: str, f: Callable[[pd.DataFrame], float]) -> DataFrame:
    """A caller's statistic of the six counts of each group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for counted in frames:
            yield pd.DataFrame({key: counted[key], "value": [f(row) for _, row in counted.iterrows()]})

    return tally(trials, key).mapInPandas(run, f"{key} string, value double")


def summarize_quantiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    v = F.when(F.col(value) > 0, F.col(value))
    return df.groupBy(*keys).agg(F.coalesce(F.median(v), F.lit(0.0)).alias("median_positive"))


