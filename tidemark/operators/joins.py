"""Joins of the warehouse, each an equi-join on its grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import add_seconds
from tidemark.operators.ordering import TIME, explode_grid


def flag_absent(fact: DataFrame, absent: DataFrame, keys=(TIME,)) -> DataFrame:
    """Left join turned into a flag."""
    known = absent.select(*keys).distinct().withColumn("is_known_absent", F.lit(True))
    return fact.join(known, list(keys), "left").withColumn(
        "is_known_absent", F.col("is_known_absent").isNotNull()
    )


def coverage_join(spine: DataFrame, landed: DataFrame, time: str = TIME) -> DataFrame:
    """Spine with the landed period beside it, null where nothing landed."""
    held = landed.select(F.col(time).alias("landed_utc")).distinct()
    return spine.join(held, F.col(time) == F.col("landed_utc"), "left")


def missing(spine: DataFrame, landed: DataFrame, keys=(TIME,)) -> DataFrame:
    """Expected but not landed."""
    return spine.join(landed.select(*keys), list(keys), "left_anti")


def missing_unexcused(spine, landed, absent, source: str, keys=(TIME,)) -> DataFrame:
    """Expected, not landed and not registered as absent for this source."""
    excused = absent.where(F.col("source") == source).select(TIME)
    return missing(spine, landed, keys).join(excused, TIME, "left_anti")


def unscored(points: DataFrame, scores: DataFrame) -> DataFrame:
    """Forecasts without a score."""
    return points.join(scores.select("forecast_id"), "forecast_id", "left_anti")


def expand_windows(windows: DataFrame, spine: DataFrame, step: int = C.STEP_SECONDS) -> DataFrame:
    """Spine periods inside half-open windows.

    Windows become their periods first, so the range condition turns into an
    equi-join and no window is compared with the whole spine.
    """
    periods = explode_grid(windows, "window_from_utc", "window_to_utc", step, TIME)
    return periods.join(spine.select(TIME), TIME)


def shift_join(
    series: DataFrame, keys: Sequence[str], delta_seconds: int, value="actual", time=TIME
) -> DataFrame:
    """Each row beside the value ``delta_seconds`` earlier."""
    earlier = series.select(
        *keys,
        add_seconds(time, delta_seconds).alias(time),
        F.col(value).alias(f"{value}_earlier"),
    )
    return series.join(earlier, [*keys, time])


def align_hourly(weather: DataFrame, spine: DataFrame, hour: str = "hour_start_utc") -> DataFrame:
    """Hourly rows held over both half hours of the spine (step hold)."""
    halves = weather.withColumn(
        TIME,
        F.explode(F.array(F.col(hour), add_seconds(hour, C.STEP_SECONDS))),
    )
    return halves.join(spine.select(TIME), TIME, "left_semi").withColumn(
        "alignment_method", F.lit("step_hold")
    )


def scored_rows(points: DataFrame, scores: DataFrame) -> DataFrame:
    """J10, first half: forecasts beside their scores."""
    extra = [c for c in scores.columns if c not in points.columns or c == "forecast_id"]
    return points.join(scores.select(*extra), "forecast_id")


def with_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """The columns of a one-row aggregate beside every row, as scalar subqueries."""
    out = df
    for c in bounds.columns:
        out = out.withColumn(c, bounds.select(c).scalar())
    return out


def weather_mix(weather: DataFrame, mix: DataFrame) -> DataFrame:
    """J12."""
    return weather.join(mix, TIME)


def champion_points(points: DataFrame, registry: DataFrame) -> DataFrame:
    """Forecasts of the model whose role is champion."""
    champion = registry.where(F.col("role") == "champion").select("model_version")
    return points.join(champion, "model_version", "left_semi")


def lookup_targets(targets: DataFrame, wide: DataFrame, target="target_utc") -> DataFrame:
    """Columns of a wide table at each target; null where it has no row."""
    return targets.join(wide.withColumnRenamed(TIME, target), target, "left")


def targets_present(targets: DataFrame, series: DataFrame, keys, target="target_utc") -> DataFrame:
    """Targets whose period exists in the series."""
    return targets.join(
        series.select(*keys, F.col(TIME).alias(target)), [*keys, target], "left_semi"
    )


def covered_days(days: DataFrame, years: DataFrame) -> DataFrame:
    """J13."""
    return days.join(years, "yr")
