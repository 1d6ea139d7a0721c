"""Gap healing, the usage ledger and the status of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import instant
from tidemark.operators.joins import missing_unexcused
from tidemark.operators.ordering import TIME, coalesce_periods
from tidemark.plans.register import newest
from tidemark.sources.windows import request_windows


def find_gaps(
    spine: DataFrame,
    landing: DataFrame,
    absent: DataFrame,
    source: str,
    as_of: Column,
    lookback_days: int = 14,
    grace_hours: int = C.GAP_GRACE_HOURS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """G1: periods that should have landed by now and are not known to be absent.

    With ``keys`` the spine carries one set of expected periods per key.
    """
    since = as_of - F.expr(f"interval {lookback_days} days")
    until = as_of - F.expr(f"interval {grace_hours} hours")
    due = spine.where((F.col(TIME) >= since) & (F.col(TIME) < until)).select(*keys, TIME)
    held = landing.where((F.col(TIME) >= since) & (F.col(TIME) < until))
    return missing_unexcused(due, held, absent, source, [*keys, TIME])


def heal_plan(gaps: DataFrame, source: C.Source, keys: Sequence[str] = ()) -> DataFrame:
    """Contiguous windows to refetch, none longer than the feed accepts."""
    windows = coalesce_periods(gaps, keys)
    return request_windows(windows, int(source.max_window.total_seconds())).withColumn(
        "source", F.lit(source.name)
    )


def heal_outcome(gaps: DataFrame, landing: DataFrame) -> DataFrame:
    """How many missing periods landed; partial when fewer than were missing."""
    now = landing.select(TIME).distinct().withColumn("__here", F.lit(1))
    return (
        gaps.join(now, TIME, "left")
        .agg(F.count(F.lit(1)).alias("missing"), F.count("__here").alias("healed"))
        .withColumn("is_partial", F.col("healed") < F.col("missing"))
    )


def source_windows(
    source: C.Source, start: datetime, end: datetime, as_of: datetime
) -> list[tuple[datetime, datetime]]:
    """S8 for one source: adjoining windows that its feed accepts; a feed that only looks back ends at ``as_of``."""
    end = min(end, as_of) if source.backward_only else end
    out = []
    while start < end:
        stop = min(start + source.max_window, end)
        out.append((start, stop))
        start = stop
    return out


def ingest_plan(
    as_of: datetime, names=C.SCHEDULED, back_days: float = 2, ahead_days: float = 2
) -> list[tuple[str, list[tuple[datetime, datetime]]]]:
    """The sources of a run, deferred ones left out, each with the windows to request."""
    start, end = as_of - timedelta(days=back_days), as_of + timedelta(days=ahead_days)
    return [
        (n, source_windows(C.SOURCES[n], start, end, as_of))
        for n in names
        if not C.SOURCES[n].deferred
    ]


def spine_stats(spine: DataFrame) -> DataFrame:
    """A27."""
    return spine.agg(
        F.count(F.lit(1)).alias("periods"),
        F.min(TIME).alias("first_period_utc"),
        F.max(TIME).alias("last_period_utc"),
    )


def period_start(as_of: datetime, reset_day: int) -> datetime:
    """When the billing period that holds ``as_of`` began."""
    day = max(1, min(28, reset_day))
    start = as_of.replace(day=day, hour=0, minute=0, second=0, microsecond=0)
    if as_of.day >= day:
        return start
    if start.month == 1:
        return start.replace(year=start.year - 1, month=12)
    return start.replace(month=start.month - 1)


def usage_state(
    ledger: DataFrame,
    as_of: datetime,
    reset_day: int = 1,
    budget: int = C.TRANSFER_BUDGET_BYTES,
) -> DataFrame:
    """Use since the billing period began, and whether to warn or stand down."""
    since = period_start(as_of, reset_day)
    share = F.col("bytes_estimated") / F.lit(budget)
    return (
        ledger.where(F.col("recorded_at_utc") >= instant(since))
        .agg(
            F.coalesce(F.sum("bytes_estimated"), F.lit(0)).alias("bytes_estimated"),
            F.coalesce(F.sum("rows_returned"), F.lit(0)).alias("rows_returned"),
            F.count(F.lit(1)).alias("runs_recorded"),
        )
        .withColumn("fraction_used", F.round(share, 4))
        .withColumn(
            "state",
            F.when(share >= C.OVER_FRACTION, "over")
            .when(share >= C.WARN_FRACTION, "warn")
            .otherwise("ok"),
        )
    )


def status(spine: DataFrame, runs: DataFrame, ledger: DataFrame, as_of: datetime, **usage):
    """The spine's extent, the usage state and the warnings, as one row."""
    use = usage_state(ledger, as_of, **usage)
    packed = use.select(F.struct("fraction_used", "state")).scalar()
    some = runs.agg(F.count(F.lit(1)))
    out = spine_stats(spine).withColumn("__u", packed).withColumn("runs", some.scalar())
    warnings = F.array_compact(
        F.array(
            F.when(F.col("__u.state") != "ok", F.concat(F.lit("transfer "), F.col("__u.state"))),
            F.when(F.col("runs") == 0, F.lit("no runs recorded")),
        )
    )
    return out.select(
        "periods",
        "first_period_utc",
        "last_period_utc",
        "runs",
        F.col("__u.fraction_used").alias("fraction_used"),
        F.col("__u.state").alias("transfer_state"),
        warnings.alias("warnings"),
    )


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """K2: the newest rows of the run log."""
    return newest(runs, ["started_at_utc", "run_id", "source"], n)
