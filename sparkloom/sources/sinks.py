"""Sinks: canonical lines, tables of text, outputs that are written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def canonical(df: DataFrame) -> Column:
    """A row as compact JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, *order: Column) -> None:
    """Lines in a total order over the files of the output: a range sort, not one task."""
    line = canonical(df)
    (df.orderBy(*order) if order else df).select(line.alias("value")).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("lineSep", "\n").option("nullValue", "").csv(path)


def write_once(df: DataFrame, path: str, key: Column) -> bool:
    """Writes a Parquet output; the same rows again are no change, other rows an error. True if written."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        df.write.parquet(path)
        return True
    there = spark.read.parquet(path).select(*df.columns)
    if there.exceptAll(df).isEmpty() and df.exceptAll(there).isEmpty():
        return False
    raise FileExistsError(f"{path} holds other rows")


def digest(df: DataFrame) -> DataFrame:
    """One row that tells whether two outputs hold equal rows in any order: a count and a sum of hashes."""
    h = F.conv(F.substring(F.sha2(canonical(df), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("digest"))


def small_rows(df: DataFrame, most: int) -> list[Row]:
    """All rows of a result that is small; more than `most` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows is no report")
    return rows


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A small result as a Markdown table."""
    rows = small_rows(df, most)
    cell = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return "\n".join([f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *[f"| {' | '.join(map(cell, r))} |" for r in rows]]) + "\n"


def latex(df: DataFrame, most: int = 1_000) -> str:
    """A small result as the body of a LaTeX table."""
    rows = small_rows(df, most)
    cell = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    return "\n".join(" & ".join(map(cell, r)) + r" \\" for r in rows) + "\n"
