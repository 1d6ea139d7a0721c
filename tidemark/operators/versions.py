"""Append-only landing: what changed, what is current, what was held when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import _CH, _chunk, ordinal
from tidemark.session import written

FETCHED = "fetched_at_utc"
ORDER = (FETCHED, "landing_id")


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """L3: one row per key, the greatest in a total order.

    An aggregate, so all but one row per key and input partition is dropped
    before the shuffle and a much-revised key costs no more than another.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
        .select(*keys, "__r.*")
    )


def landing_history(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L4: number of rows, first sight and distinct payloads per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("revision_count"),
        F.min(FETCHED).alias("first_seen_at_utc"),
        F.countDistinct("payload_hash").alias("distinct_payloads"),
    )


def resolve(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """Current row with its revision facts, fused into one aggregate and one shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"),
            F.count(F.lit(1)).alias("revision_count"),
            F.min(FETCHED).alias("first_seen_at_utc"),
        )
        .select(*keys, "__r.*", "revision_count", "first_seen_at_utc")
    )


def bounded_by(df: DataFrame, batch: DataFrame, time: str) -> DataFrame:
    """Rows within the batch's time span; scalar subqueries reach the scan.

    Where the table is partitioned by ``day``, whole days are skipped unread.
    """
    lo = batch.agg(F.min(time)).scalar()
    hi = batch.agg(F.max(time)).scalar()
    if "day" in df.columns:
        first = batch.agg(F.to_date(F.min(time))).scalar()
        last = batch.agg(F.to_date(F.max(time))).scalar()
        df = df.where(F.col("day").between(first, last))
    return df.where(F.col(time).between(lo, hi))


def insert_if_changed(
    landing: DataFrame, batch: DataFrame, keys: Sequence[str], time: str = "sp_start_utc"
) -> DataFrame:
    """L1: batch rows whose hash differs from the latest stored hash of the key.

    A, B, A stores three rows. Rows repeated inside one batch are all kept.
    """
    latest = latest_row(
        bounded_by(landing, batch, time).select(*keys, "payload_hash", *ORDER), keys
    ).select(*keys, "payload_hash")
    return batch.join(latest, [*keys, "payload_hash"], "left_anti")


def last_landing_id(landing: DataFrame) -> Column:
    """The stored maximum, zero for an empty table, as a scalar subquery."""
    return landing.agg(F.coalesce(F.max("landing_id"), F.lit(0))).scalar()


def with_landing_ids(batch: DataFrame, after: Column, keys: Sequence[str]) -> DataFrame:
    """Ids that continue after a given one, in (fetched, keys, hash) order.

    Rows are dealt to tasks in ranges of that order and written once; a row's id
    is its place in its task plus the counts of the tasks before, one number a
    task. So a batch of one fetch time is numbered by many tasks. Rows equal in
    the whole order are interchangeable.
    """
    order = [FETCHED, *keys, "payload_hash"]
    placed = written(
        batch.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id()),
        "numbered",
    )
    # the task stands above bit 33, the place in it below
    task = F.shiftright("__place", 33)
    counts = placed.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    place = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("__task", task)
        .join(F.broadcast(offsets), "__task")  # one row a task
        .withColumn("landing_id", place + F.col("__before") + 1 + after)
        .drop("__place", "__task", "__before")
    )


def demand_current(vintages: DataFrame, keys=("sp_start_utc",), publish="publish_time_utc"):
    """The latest published vintage per period."""
    tie = [c for c in ("landing_id",) if c in vintages.columns]
    return latest_row(vintages, list(keys), [publish, *tie])


def current_benchmark(landing: DataFrame, keys, value: str, anchor: Column, time="sp_start_utc"):
    """Latest non-null published forecast of the periods after the anchor."""
    ahead = landing.where((F.col(time) > anchor) & F.col(value).isNotNull())
    return latest_row(ahead, keys)


def _same(a: str, b: str, check: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in check:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def scd2(
    df: DataFrame, keys: Sequence[str], check: Sequence[str], chunk_seconds: int = 6 * 3600
) -> DataFrame:
    """Validity intervals of each distinct run of the checked columns.

    ``valid_to`` is null on the open row. Versions of one key are compared in
    chunks of a few hours, so a key with many versions is not sorted by one task.
    One pass over a chunk, newest first, finds its changes and the change after
    each; only those and the chunk's oldest row go on. One row a chunk then
    carries both neighbours across borders: what was held before, which decides
    whether the oldest row is a change, and when the next change comes.
    """
    keys, since = list(keys), "__since"
    held = F.struct(*check)
    chunk = Window.partitionBy(*keys, _CH).orderBy(F.col(FETCHED).desc(), F.col("landing_id").desc())
    newer = chunk.rowsBetween(Window.unboundedPreceding, -1)
    changed = F.col("__was").isNotNull() & ~_same("__held", "__was", check)
    rows = (
        df.select(*keys, held.alias("__held"), FETCHED, "landing_id")
        .withColumn(_CH, _chunk(FETCHED, chunk_seconds))
        .withColumn("__was", F.lead("__held").over(chunk))
        .withColumn("__oldest", F.col("__was").isNull())
        .withColumn("__changed", changed)
        .withColumn("__next", F.last(F.when(F.col("__changed"), F.col(FETCHED)), ignorenulls=True).over(newer))
        .where(F.col("__changed") | F.col("__oldest"))
        .drop("__was")
    )
    oldest = F.when(F.col("__oldest"), F.struct("__held", FETCHED, "__next"))
    edges = (
        rows.groupBy(*keys, _CH)
        .agg(
            F.max_by("__held", F.struct(FETCHED, "landing_id")).alias("__newest"),
            F.first(oldest, ignorenulls=True).alias("__first"),
        )
        .select(*keys, _CH, "__newest", F.col("__first.__held").alias("__edge"),
                F.col(f"__first.{FETCHED}").alias(since), F.col("__first.__next").alias("__after"))
    )
    chunks = Window.partitionBy(*keys).orderBy(F.col(_CH).desc())
    carried = (
        edges.withColumn("__before", F.lead("__newest").over(chunks))
        .withColumn("__opens", F.col("__before").isNull() | ~_same("__edge", "__before", check))
        .withColumn("__at", F.when(F.col("__opens"), F.col(since)).otherwise(F.col("__after")))
        .withColumn(
            "__later",
            F.last("__at", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select(*keys, _CH, "__opens", "__later")
    )
    return (
        rows.join(carried, [*keys, _CH])
        .where(F.col("__changed") | F.col("__opens"))
        .select(
            *keys,
            *[F.col(f"__held.{c}").alias(c) for c in check],
            F.col(FETCHED).alias("valid_from"),
            F.coalesce("__next", "__later").alias("valid_to"),
            "landing_id",
        )
    )


def scd2_apply(
    history: DataFrame, batch: DataFrame, keys: Sequence[str], check: Sequence[str]
) -> DataFrame:
    """L7, incremental: the stored history extended by rows fetched since.

    Only open rows meet the batch; closed rows pass through untouched.
    """
    opened = history.where(F.col("valid_to").isNull())
    touched = opened.join(batch.select(*keys).distinct(), list(keys), "left_semi")
    kept = opened.join(batch.select(*keys).distinct(), list(keys), "left_anti")
    rows = touched.select(*keys, *check, F.col("valid_from").alias(FETCHED), "landing_id")
    fresh = scd2(
        rows.unionByName(batch.select(*keys, *check, FETCHED, "landing_id")), keys, check
    )
    return history.where(F.col("valid_to").isNotNull()).unionByName(kept).unionByName(fresh)


def conflicting_versions(
    df: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Every version of the keys reported more than once, one row each.

    ``position`` counts the key's versions in landing order. Counts of the key
    stand on each of its rows; nothing is gathered.
    """
    facts = (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("versions"),
            F.countDistinct(FETCHED).alias("distinct_fetch_times"),
            F.countDistinct("payload_hash").alias("distinct_payloads"),
        )
        .where(F.col("versions") > 1)
        .withColumn(
            "ordering_is_ambiguous", F.col("versions") > F.col("distinct_fetch_times")
        )
    )
    # Ids stand in for microseconds, so that a chunk of one second holds at most a
    # million of them.
    by_id = df.select(
        *keys, "landing_id", *fields, F.timestamp_micros("landing_id").alias("__at")
    )
    numbered = ordinal(by_id, keys, "position", "__at", chunk_seconds=1).drop("__at")
    return facts.join(numbered, list(keys))


def retention_report(df: DataFrame, time: str, keep_days: int, as_of: Column) -> DataFrame:
    """What a prune would delete and keep."""
    old = F.col(time) < as_of - F.expr(f"interval {keep_days} days")
    return df.agg(
        F.count_if(old).alias("delete_count"),
        F.count_if(~old).alias("keep_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.min(time).alias("oldest"),
        F.max(time).alias("newest"),
    )


def prune(
    df: DataFrame, time: str, keep_days: int, as_of: Column, required_mart: DataFrame | None = None
) -> DataFrame:
    """The rows to keep. Refuses when the mart that backs the table is empty."""
    if required_mart is not None and required_mart.isEmpty():
        raise ValueError("the mart that must hold this data is empty; nothing is pruned")
    return df.where(F.col(time) >= as_of - F.expr(f"interval {keep_days} days"))


def lifecycle(facts: DataFrame) -> DataFrame:
    """T-3: one state per period."""
    return facts.withColumn(
        "state",
        F.when(F.col("is_permanently_unscoreable"), "unscoreable")
        .when(F.col("is_matured"), "matured")
        .otherwise("pending"),
    )
