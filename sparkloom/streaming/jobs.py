"""Incremental forms of the operators: file streams with checkpoints that stop once they have read what is there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names; below a temporary one only where all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-stream-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a Parquet table, with the schema of the table; timestamps are instants."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        rows = reader.parquet(path)
    else:  # a stream reads folders: the one that holds the file
        rows = reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_to_table(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; complete results replace those before."""
    spark = stream.sparkSession
    out = f"{folder}/out"

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(replace).start() if mode == "complete" else writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(events: DataFrame, width: str, *keys: str) -> DataFrame:
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Runs of events of a key with gaps no longer than gap."""
    return events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"), F.max("ts").alias("ended"))


def first_receipts(events: DataFrame, within: str, *keys: str) -> DataFrame:
    """One row per key of those that come within so long of each other (by ts); older keys leave the state."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(list(keys))


def first_receipts_table(stream: DataFrame, folder: str, *keys: str) -> DataFrame:
    """One row per key, whichever batch brings it first. What is known is a table, not state in memory; a batch that is
    run again writes its own part anew."""
    spark, out = stream.sparkSession, f"{folder}/receipts"
    known = spark.createDataFrame([], stream.select(*keys).schema)

    def apply(batch: DataFrame, number: int) -> None:
        before = known if not number else spark.read.schema(f"{known_ddl}, batch int").option("basePath", out).parquet(out).filter(F.col("batch") < number).select(*keys)
        batch.select(*keys).distinct().join(before, list(keys), "left_anti").write.mode("overwrite").parquet(f"{out}/batch={number}")

    known_ddl = ", ".join(f"{c} {kind}" for c, kind in known.dtypes)
    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
    return spark.read.schema(f"{known_ddl}, batch int").parquet(out).drop("batch")


def last_states(events: DataFrame, key: str) -> DataFrame:
    """The last known state per key and how often it changed, as a stateful operator."""

    def update(k, frames, state):
        at, value, changes = state.get if state.exists else (None, None, 0)
        for f in frames:
            for ts, v in sorted(zip(f["us"], f["event_type"])):
                changes += v != value
                if at is None or ts >= at:
                    at, value = ts, v
        state.update((at, value, changes))
        yield pd.DataFrame({key: [k[0]], "us": [at], "state": [value]})

    rows = events.select(key, F.unix_micros("ts").alias("us"), "event_type")
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} long, us long, state string", "us long, state string, changes long", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, folder: str, key: str, version: str) -> DataFrame:
    """Applies changes batch by batch; what is kept is the newest row per key. Replayed batches change nothing."""
    spark = stream.sparkSession
    log = f"{folder}/changes"

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), version).alias("x")).select(key, "x.*")
        newest.write.mode("overwrite").parquet(f"{log}/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
    rows = spark.read.parquet(log).drop("batch")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), version).alias("x")).select(key, "x.*")


def each_batch(stream: DataFrame, folder: str, done: Callable[[], DataFrame], key: str, work: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Works on the rows of each batch that are not done yet and adds the results."""

    def apply(batch: DataFrame, number: int) -> None:
        work(batch.join(done().select(key), key, "left_anti")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
