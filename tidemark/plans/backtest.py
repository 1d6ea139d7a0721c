"""Rolling-origin backtests of the baselines, as one plan over all issue times."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import metrics as M
from tidemark.functions.scalar import add_seconds, epoch, horizon_group, period_of_day
from tidemark.operators.asof import asof_last, seasonal_asof
from tidemark.operators.ordering import TIME, explode_origins

MODELS = {
    "b0": "B0_persistence",
    "b1": "B1_seasonal_naive",
    "b2": "B2_weekly_naive",
    "b3": "B3_climatology",
    "benchmark": "published_benchmark",
}


def profile_builds(spark: SparkSession, grid: C.Grid, embargo_hours: int) -> DataFrame:
    """When each month's climatology is built: at the month's first issue time.

    Two rows per month of the grid, as a 48 hour horizon reaches the month of
    the issue time and the next. This is configuration, not data.
    """
    rows, seen = [], set()
    for k in range(grid.count):
        at = grid.start + timedelta(hours=k * grid.step_hours)
        month = at.year * 100 + at.month
        if month in seen:
            continue
        seen.add(month)
        until = at - timedelta(hours=embargo_hours)
        for cal in (at.month, at.month % 12 + 1):
            rows.append((month, cal, int(until.timestamp())))
    return spark.createDataFrame(rows, "origin_month int, cal_month int, until long")


def climatology_profile(
    series: DataFrame,
    builds: DataFrame,
    keys: Sequence[str],
    value: str = "actual",
    days: int = C.CLIMATOLOGY_DAYS,
) -> DataFrame:
    """Medians by (month, period of day) over the trailing days to each build.

    A group holds at most 31 values a year for three years. The builds are two
    rows per month of issue times, hence the broadcast.
    """
    t = epoch(TIME)
    seen = (
        series.where(F.col(value).isNotNull())
        .withColumn("cal_month", F.month(TIME))
        .withColumn("pod", period_of_day(TIME))
        .join(F.broadcast(builds), "cal_month")
        .where((t <= F.col("until")) & (t > F.col("until") - days * C.DAY_SECONDS))
    )
    return seen.groupBy(*keys, "origin_month", "cal_month", "pod").agg(
        F.percentile(F.col(value).cast("double"), 0.5).alias("median")
    )


def climatology(series, targets, grid, keys, embargo_hours=C.EMBARGO_HOURS, out="b3") -> DataFrame:
    """each target with the profile built in the month of its issue time."""
    spark = series.sparkSession
    profile = climatology_profile(series, profile_builds(spark, grid, embargo_hours), keys)
    placed = (
        targets.withColumn("origin_month", F.year("origin_utc") * 100 + F.month("origin_utc"))
        .withColumn("cal_month", F.month("target_utc"))
        .withColumn("pod", period_of_day("target_utc"))
    )
    on = [*keys, "origin_month", "cal_month", "pod"]
    return (
        placed.join(profile.withColumnRenamed("median", out), on, "left")
        .drop("origin_month", "cal_month", "pod")
    )


def backtest_targets(
    series: DataFrame,
    grid: C.Grid,
    embargo_hours: int = C.EMBARGO_HOURS,
    horizons: int = C.HORIZONS,
) -> DataFrame:
    """Every usable period once per issue time whose horizon reaches it.

    The period brings its own truth, so neither the grid nor the truth needs a
    join.
    """
    usable = series.where(F.col("is_comparable") & F.col("actual").isNotNull())
    step = C.STEP_SECONDS
    rows = explode_origins(usable, grid, TIME, step, horizons * step)
    return (
        rows.withColumnRenamed(TIME, "target_utc")
        .withColumn(
            "horizon", ((epoch("target_utc") - epoch("origin_utc")) / step).cast("int")
        )
        .withColumn("known_until_utc", add_seconds("origin_utc", -embargo_hours * 3600))
    )


def reachable(series: DataFrame, grid: C.Grid, embargo_hours: int) -> DataFrame:
    """The rows a seasonal walk back from the grid can land on; the bounds reach the scan."""
    step, known = C.STEP_SECONDS, int(grid.start.timestamp()) - embargo_hours * 3600
    last = known + (grid.count - 1) * grid.step_seconds
    first = known - C.WALKBACK_STEPS * C.SEASON_WEEK * step
    return series.where(
        F.col(TIME).between(F.timestamp_seconds(F.lit(first)), F.timestamp_seconds(F.lit(last)))
    )


def persistence(series, targets, keys, out="b0") -> DataFrame:
    """the last known value, one look-up per issue time."""
    probes = targets.select(*keys, "origin_utc", "known_until_utc").distinct()
    held = asof_last(series, probes, keys, "actual", "known_until_utc", out=out)
    return targets.join(held.select(*keys, "origin_utc", out), [*keys, "origin_utc"], "left")


def backtest(
    series: DataFrame,
    grid: C.Grid,
    keys: Sequence[str] = ("series_key",),
    embargo_hours: int = C.EMBARGO_HOURS,
    strict: bool = False,
) -> DataFrame:
    """one row per (origin, model, horizon) with the truth and the prediction.

    ``series`` has keys, sp_start_utc, actual, benchmark and is_comparable. By
    default each model loses only its own nulls; ``strict`` keeps the targets
    that every model predicted.
    """
    keys = list(keys)
    slim = series.select(*keys, TIME, "actual", "benchmark", "is_comparable")
    rows = backtest_targets(slim, grid, embargo_hours).drop("is_comparable")
    rows = persistence(slim, rows, keys)
    rows = seasonal_asof(
        reachable(slim, grid, embargo_hours), rows, keys,
        {"b1": C.SEASON_DAY, "b2": C.SEASON_WEEK},
    )
    rows = climatology(slim, rows, grid, keys, embargo_hours)
    if strict:
        rows = rows.dropna(subset=list(MODELS))
    kind = "decimal(18,3)" if "decimal" in dict(slim.dtypes)["actual"] else "double"
    pairs = ", ".join(f"'{name}', cast({c} as {kind})" for c, name in MODELS.items())
    return rows.select(
        *keys,
        "origin_utc",
        "target_utc",
        "horizon",
        F.col("actual").cast(kind).alias("actual"),
        F.expr(f"stack({len(MODELS)}, {pairs}) as (model, pred)"),
    ).where(F.col("pred").isNotNull())


def summarise(
    points: DataFrame, scale: DataFrame, keys: Sequence[str] = ("series_key",)
) -> DataFrame:
    """Accuracy per model and horizon group, always with its sample size.

    ``scale`` carries one MASE denominator per key.
    """
    keys = list(keys)
    by = points.withColumn("horizon_group", horizon_group("horizon"))
    out = by.groupBy(*keys, "model", "horizon_group").agg(
        F.count(F.lit(1)).alias("n"),
        M.mae("actual", "pred").alias("mae"),
        M.rmse("actual", "pred").alias("rmse"),
        M.bias("actual", "pred").alias("bias"),
    )
    joined = out.join(scale, keys, "left") if keys else out.withColumn("scale", scale.scalar())
    return joined.withColumn(
        "mase", F.when(F.col("scale") > 0, F.col("mae") / F.col("scale"))
    ).drop("scale")
