"""A view of a folder of line files that is kept by what has changed in it, deletions included.

Each refresh lists the folder (path, size, time of change; no contents) and compares it with the manifest of the
refresh before. Only new and changed files are read; their rows are one delta, and every file that changed or went gets
a tombstone in it, so its older rows count no more. The manifest is written last and commits the delta: a refresh that
failed or is run again writes the same version anew. Compaction folds all deltas into one.

A file that is written again with the same size within one tick of the clock isn't seen to have changed. Lines that are
no records of the schema are kept as rows of nulls with their text in `_broken`. A folder without files gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changed files that are named one by one; beyond that the folder is read and joined with their names.
MOST_NAMED = 1_000

MANIFEST = "uri string, path string, size long, changed_at timestamp"
FILES = "uri string, version int, deleted boolean"


def _versions(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of complete versions, from the names of their folders."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    names = [s.getPath() for s in system.listStatus(place)]
    whole = [p.getName() for p in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(m[1]) for n in whole if (m := re.fullmatch(r"version=(\d+)", n)))


def listing(spark: SparkSession, source: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(source)
    return files.select(F.col("_metadata.file_path").alias("uri"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"))


def refresh(spark: SparkSession, source: str, folder: str, schema: str, pattern: str = "*.json") -> dict[str, int]:
    """Brings the view in folder up to the files of source: how many are new, changed and gone. schema: of a line."""
    done = _versions(spark, folder, "manifest")
    version = done[-1] + 1 if done else 0
    before = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/version={done[-1]}") if done else spark.createDataFrame([], MANIFEST)
    listed = f"{folder}/listing/version={version}"
    listing(spark, source, pattern).write.mode("overwrite").parquet(listed)  # one listing for all that follows
    now = spark.read.schema(MANIFEST).parquet(listed)
    old = before.select("uri", F.col("size").alias("old_size"), F.col("changed_at").alias("old_at"))
    kind = (
        F.when(F.col("old_size").isNull(), "new")
        .when(F.col("size").isNull(), "gone")
        .when((F.col("size") != F.col("old_size")) | (F.col("changed_at") != F.col("old_at")), "changed")
    )
    found = now.join(old, "uri", "full").select("uri", "path", kind.alias("kind")).filter("kind is not null")
    found.write.mode("overwrite").parquet(f"{folder}/found/version={version}")
    found = spark.read.schema("uri string, path string, kind string").parquet(f"{folder}/found/version={version}")
    counts = {"new": 0, "changed": 0, "gone": 0} | {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    if not any(counts.values()) and done:
        return counts
    fresh = found.filter("kind <> 'gone'").select("uri", "path")
    reader = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken")
    uri = F.col("_metadata.file_path").alias("_path")
    if counts["new"] + counts["changed"] == 0:
        rows = None
    elif counts["new"] + counts["changed"] <= MOST_NAMED:
        rows = reader.json([r["path"] for r in fresh.collect()]).select("*", uri)
    else:
        whole = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").json(source).select("*", uri)
        rows = whole.join(fresh, F.col("_path") == F.col("uri"), "left_semi")
    if rows is not None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/version={version}")
    found.select("uri", F.lit(version).alias("version"), (F.col("kind") == "gone").alias("deleted")).write.mode("overwrite").parquet(f"{folder}/files/version={version}")
    now.write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
    return counts


def view(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all files that the last refresh saw, each file's last version; `_path` is the file's URI."""
    done = set(_versions(spark, folder, "manifest"))
    parts = [v for v in _versions(spark, folder, "files") if v in done]
    whole = f"{schema}, _broken string, _path string"
    held = [v for v in _versions(spark, folder, "rows") if v in parts]
    if not held:
        return spark.createDataFrame([], whole)
    files = spark.read.schema(FILES).parquet(*[f"{folder}/files/version={v}" for v in parts])
    last = files.groupBy("uri").agg(F.max(F.struct("version", "deleted")).alias("x")).filter("not x.deleted").select(F.col("uri").alias("_path"), F.col("x.version").alias("version"))
    rows = spark.read.schema(f"{whole}, version int").option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/version={v}" for v in held])
    return rows.join(last, ["_path", "version"], "left_semi").drop("version")


def compact(spark: SparkSession, folder: str, schema: str) -> None:
    """Folds all deltas into the version of the last refresh; older ones may be removed once this is done."""
    done = _versions(spark, folder, "manifest")
    if len(done) < 2:
        return
    last = done[-1]
    target = last + 1
    view(spark, folder, schema).write.mode("overwrite").parquet(f"{folder}/rows/version={target}")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/version={last}")
    manifest.select("uri", F.lit(target).alias("version"), F.lit(False).alias("deleted")).write.mode("overwrite").parquet(f"{folder}/files/version={target}")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest/version={target}")
