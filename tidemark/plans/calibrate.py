"""Empirical error quantiles per horizon band, stored daily and read back whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import seasons_back
from tidemark.operators.ordering import TIME, ordinal


def error_quantiles(
    series: DataFrame,
    keys: Sequence[str],
    value: str = "actual",
    levels: dict[str, float] = C.QUANTILE_LEVELS,
    min_rows: int = C.CALIBRATION_MIN_ROWS,
) -> DataFrame:
    """Quantiles of v[i] - v[i - lag] by row position, per band.

    Bands with the same lag share one self-join. A group holds the rows of one
    series within the calibration window (17,520 half hours a year). Series with
    at most ``min_rows`` rows get no calibration.
    """
    keys = list(keys)
    pos = ordinal(series.where(F.col(value).isNotNull()), keys, "__pos").select(
        *keys, "__pos", F.col(value).alias("__v")
    )
    sizes = pos.groupBy(*keys).agg(F.max("__pos").alias("__rows"))
    lags = sorted({seasons_back(high) for _, _, high in C.HORIZON_GROUPS})
    ahead = pos.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags])))
    back = pos.select(*keys, F.col("__pos").alias("__from"), F.col("__v").alias("__was"))
    pairs = ahead.withColumn("__from", F.col("__pos") - F.col("lag")).join(
        back, [*keys, "__from"]
    )
    error = (F.col("__v") - F.col("__was")).cast("double")
    stats = pairs.groupBy(*keys, "lag").agg(
        F.percentile(error, list(levels.values())).alias("__q")
    )
    stats = stats.join(sizes.where(F.col("__rows") > min_rows), keys) if keys else (
        stats.withColumn("__rows", sizes.select("__rows").scalar()).where(
            F.col("__rows") > min_rows
        )
    )
    bands = F.array(
        *[
            F.struct(
                F.lit(low).alias("band_low"),
                F.lit(high).alias("band_high"),
                F.lit(seasons_back(high)).alias("lag"),
            )
            for _, low, high in C.HORIZON_GROUPS
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("quantile_name"), F.col("__q")[i].alias("offset"))
            for i, n in enumerate(levels)
        ]
    )
    return (
        stats.withColumn("b", F.explode(bands))
        .where(F.col("b.lag") == F.col("lag"))
        .withColumn("c", F.explode(cells))
        .select(
            *keys,
            "b.band_low",
            "b.band_high",
            "c.quantile_name",
            "c.offset",
            (F.col("__rows") - F.col("lag")).alias("n_samples"),
        )
    )


def calibrate(
    facts: DataFrame,
    keys: Sequence[str],
    as_of: Column,
    run_id: str,
    days: int = C.CALIBRATION_DAYS,
) -> DataFrame:
    """the calibration rows of one run over matured actuals of the window."""
    since = as_of - F.expr(f"interval {days} days")
    window = facts.where(F.col("is_matured") & (F.col(TIME) >= since))
    return (
        error_quantiles(window, keys)
        .withColumn("calibration_run_id", F.lit(run_id))
        .withColumn("source_days", F.lit(days))
        .withColumn("computed_at_utc", as_of)
    )


def newest_set(
    table: DataFrame, run_col: str = "calibration_run_id", order: Sequence[str] = ("computed_at_utc",)
) -> DataFrame:
    """K1: all rows of the newest run, never a blend of two."""
    newest = table.agg(F.max_by(run_col, F.struct(*order, run_col))).scalar()
    return table.where(F.col(run_col) == newest)


def load_calibration(
    table: DataFrame, as_of: Column, stale_days: int = C.CALIBRATION_STALE_DAYS
) -> DataFrame:
    """the newest set with its age; old sets are marked, not refused."""
    return (
        newest_set(table)
        .withColumn(
            "age_hours",
            (F.unix_timestamp(as_of) - F.unix_timestamp("computed_at_utc")) / 3600.0,
        )
        .withColumn("is_stale", F.col("age_hours") > stale_days * 24)
    )


def calibration_or_compute(
    table: DataFrame | None, facts: DataFrame, keys: Sequence[str], as_of: Column
) -> DataFrame:
    """the stored set, or one computed now when nothing is stored yet."""
    if table is not None and not table.isEmpty():
        return newest_set(table)
    return calibrate(facts, keys, as_of, "computed-at-issue")


def bands_wide(calibration: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and band with the four offsets as columns."""
    return calibration.groupBy(*keys, "band_low", "band_high").agg(
        *[
            F.max(F.when(F.col("quantile_name") == n, F.col("offset"))).alias(f"{n}_offset")
            for n in C.QUANTILE_LEVELS
        ]
    )
