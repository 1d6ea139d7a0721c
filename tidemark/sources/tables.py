"""Stored tables: bounded reads, appends and keyed upserts on Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.marts import merged
from tidemark.session import configure, written

MAX_LISTED = 10_000  # partition values named in a filter; beyond it a semi join


def load_history(
    df: DataFrame,
    time: str = "sp_start_utc",
    since: Column | None = None,
    until: Column | None = None,
    in_column: str | None = None,
    members: Sequence[str] = (),
) -> DataFrame:
    """Optional bounds and members; all of them reach the scan."""
    if since is not None:
        df = df.where(F.col(time) >= since)
    if until is not None:
        df = df.where(F.col(time) <= until)
    return df.where(F.col(in_column).isin(*members)) if in_column else df


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None if there is none or it holds no data file yet."""
    if not exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def one_per_grain(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """The least row of each grain, by all other columns in order."""
    rest = [c for c in df.columns if c not in grain]
    if not rest:
        return df.distinct()
    least = df.groupBy(*grain).agg(F.min(F.struct(*rest)).alias("__r"))
    return least.select(*grain, "__r.*").select(*df.columns)


def new_rows(df: DataFrame, stored: DataFrame, grain: Sequence[str]) -> DataFrame:
    """One row per grain that the stored table does not hold."""
    return one_per_grain(df, grain).join(stored.select(*grain), list(grain), "left_anti")


def listed_values(df: DataFrame, column: str) -> list | None:
    """The distinct values of a partition column, or None beyond ``MAX_LISTED``."""
    values = [r[0] for r in df.select(column).distinct().limit(MAX_LISTED + 1).collect()]
    return values if len(values) <= MAX_LISTED else None


def within(stored: DataFrame, df: DataFrame, partition: str) -> DataFrame:
    """The stored rows in the partitions that ``df`` touches, named in the scan if they are few."""
    listed = listed_values(df, partition)
    if listed is not None:
        return stored.where(F.col(partition).isin(listed))
    return stored.join(df.select(partition).distinct(), partition, "left_semi")


def append_new(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    grain: Sequence[str],
    partition_by: Sequence[str] = (),
) -> int:
    """Append with on-conflict-do-nothing on the grain; returns how many rows were new.

    Of the stored table only the partitions of the first partition column that
    the rows touch are read, so that column must derive from the grain.
    """
    df = written(df, "offered")
    if exists(spark, path):
        stored = spark.read.schema(df.schema).parquet(path)
        fresh = new_rows(df, within(stored, df, partition_by[0]) if partition_by else stored, grain)
    else:
        fresh = one_per_grain(df, grain)
    return append_counted(fresh, path, partition_by=partition_by)


def append_counted(
    df: DataFrame, path: str, expected: int | None = None, partition_by: Sequence[str] = ()
) -> int:
    """Append a summary, and refuse one with an unexpected row count.

    The rows are computed once, beside the table, counted there and then appended.
    No rows leave the table as it is, or absent.
    """
    ready = written(df, "counted")
    rows = ready.count()
    if expected is not None and rows != expected:
        raise ValueError(f"{rows} rows to store, expected {expected}")
    if rows:  # an empty partitioned table would have no schema to be read by
        ready.write.mode("append").partitionBy(*partition_by).parquet(path)
    return rows


def upsert(
    spark: SparkSession,
    path: str,
    updates: DataFrame,
    keys: Sequence[str],
    partition: str,
) -> None:
    """T-1, T-2: delete and insert by key in the date partitions the updates touch.

    Only touched partitions are read and replaced. Spark writes them to a
    staging folder and swaps them in at commit, so a lost executor costs a retry
    and a failed job leaves the table as it was. Keys must lie in one partition
    value each, as they do when the partition derives from the key's time.
    """
    configure(spark)
    if not exists(spark, path):
        updates.write.mode("overwrite").partitionBy(partition).parquet(path)
        return
    updates = written(updates, "updates")  # read three times below
    stored = spark.read.schema(updates.schema).parquet(path)
    touched = within(stored, updates, partition)
    result = merged(touched.select(*updates.columns), updates, keys)
    (
        result.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
