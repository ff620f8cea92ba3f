"""A ranking that can be read while its scores still arrive, as a stateful stream.

Candidates are dealt to shards by a hash of their key, so no shard is hot. A shard's state holds the last score of each
candidate (a map), the keys that have changed since it last wrote (a list) and their number (a value). It writes what
changed once `every` candidates have, and what is left when the watermark has passed the first of them by `flush_ms` (an event timer). A score counts if its
number (seq) is higher than the one known, so replayed and late files change nothing. The state is in RocksDB, not in
memory; what is written is a table of versions, of which readers take the last for each candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sparkloom.operators import lookups

WRITTEN = "candidate_key string, probability string, position long, seq long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a shard that are held, at least, before they are reduced to the last of each candidate.
LEAST_HELD = 100_000


def last_scores(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """The score of the highest number of each candidate; of equal numbers the first to come."""
    rows = pd.concat([p for p in parts if len(p)], ignore_index=True)
    return rows.sort_values("seq", kind="stable", ascending=False).drop_duplicates("candidate_key", keep="first")


class Shard(StatefulProcessor):
    def __init__(self, every: int, flush_ms: int):
        self.every, self.flush_ms = every, flush_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.scores = handle.getMapState("scores", "candidate_key string", "probability string, position long, seq long")
        self.changed = handle.getListState("changed", "candidate_key string")
        self.pending = handle.getValueState("pending", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call to the state is a round trip, so a candidate's scores meet it once however many batches they fill
        newest = pd.DataFrame(columns=["candidate_key", "probability", "position", "seq", "ms"])
        waiting: list[pd.DataFrame] = []
        held = 0
        for part in rows:
            waiting.append(part[newest.columns])
            held += len(part)
            if held >= max(LEAST_HELD, len(newest)):
                newest, waiting, held = last_scores([newest, *waiting]), [], 0
        if waiting:
            newest = last_scores([newest, *waiting])
        fresh, first = {}, None
        for name, probability, position, seq, ms in newest.itertuples(index=False):
            known = self.scores.getValue((name,))
            if known is None or seq > known[2]:
                fresh[name] = (probability, int(position), int(seq))
                self.scores.updateValue((name,), fresh[name])
                first = int(ms) if first is None else min(first, int(ms))
        if not fresh:
            return
        before = self.pending.get()[0] if self.pending.exists() else 0
        if before + len(fresh) >= self.every:
            yield self._write(fresh, before)
            return
        self.changed.appendList([(name,) for name in fresh])
        self.pending.update((before + len(fresh),))
        if not before:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + self.flush_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            yield self._write({}, 1)

    def _write(self, fresh: dict[str, tuple], before: int) -> pd.DataFrame:
        """What has changed: the scores at hand, and those of the keys noted before."""
        out = [(name, *score) for name, score in fresh.items()]
        if before:
            out += [(name, *self.scores.getValue((name,))) for name in {name for (name,) in self.changed.get()} - fresh.keys()]
            self.changed.clear()
            self.pending.clear()
        out.sort(key=lambda r: r[0])
        return pd.DataFrame(out, columns=[c.split()[0] for c in WRITTEN.split(", ")])

    def close(self) -> None:
        pass


def follow(scores: DataFrame, folder: str, every: int = 25, flush_ms: int = 60_000, shards: int = 200) -> None:
    """Takes in the scores that are there (a stream of candidate_key, probability, position, seq, at) and writes versions
    of what changed to folder/versions. Run again on the same folder, it goes on where it stopped. Rows without a key, a
    score, a number or a time are left out."""
    spark = scores.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    named = scores.filter("candidate_key is not null and probability is not null and seq is not null and at is not null").withWatermark("at", "0 seconds").withColumn("ms", F.unix_millis("at")).withColumn("shard", F.pmod(F.xxhash64("candidate_key"), F.lit(shards)))
    written = named.groupBy("shard").transformWithStateInPandas(Shard(every, flush_ms), WRITTEN, "Update", "EventTime")

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/versions/batch={number}")

    writer = written.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    # each partition of the state is a store to open and commit in every batch, so no more of them than shards can fill;
    # a checkpoint keeps the number it began with
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 2 * shards)))
    try:
        writer.foreachBatch(add).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def live(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of each candidate that has been written so far."""
    rows = spark.read.schema(f"{WRITTEN}, batch int").parquet(f"{folder}/versions")
    return rows.groupBy("candidate_key").agg(F.max_by(F.struct("probability", "position", "seq"), "seq").alias("x")).select("candidate_key", "x.*")


def complete(spark: SparkSession, folder: str) -> DataFrame:
    """The last score of each candidate that has come in, written or not: the state itself."""
    state = spark.read.format("statestore").option("stateVarName", "scores").load(f"{folder}/checkpoint")
    return state.select("user_map_key.candidate_key", "user_map_value.probability", "user_map_value.position", "user_map_value.seq")


def ranked(scores: DataFrame) -> DataFrame:
    """Scores with their rank from 1: by probability as an exact decimal, falling, then by key."""
    order = F.struct((-F.col("probability").try_cast("decimal(38,18)")).alias("p"), F.col("candidate_key").alias("k"))
    return lookups.positions(scores, order, "rank")
