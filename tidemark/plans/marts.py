"""The dimensional model: spine, facts and their incremental upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import (
    add_seconds,
    is_comparable,
    is_dst,
    is_matured,
    is_unscoreable,
    isodow,
    lag_minutes,
    plausible,
    iso_text,
    signed_error,
    text_key,
    to_local,
)
from tidemark.operators.joins import align_hourly, flag_absent
from tidemark.operators.ordering import TIME, period_numbers


def dim_settlement_period(spine: DataFrame, tz: str = "Europe/London") -> DataFrame:
    """The spine with its local-calendar attributes."""
    local = (
        spine.select(TIME)
        .withColumn("sp_end_utc", add_seconds(TIME, C.STEP_SECONDS))
        .withColumn("local_ts", to_local(TIME, tz))
        .withColumn("settlement_date_local", F.to_date("local_ts"))
    )
    t = F.col("local_ts")
    return period_numbers(local).select(
        TIME,
        "sp_end_utc",
        "settlement_date_local",
        "settlement_period_no",
        "periods_in_local_day",
        t.cast("timestamp_ntz").alias("local_ts"),
        F.hour(t).cast("smallint").alias("hour_local"),
        isodow(t).cast("smallint").alias("dow"),
        F.month(t).cast("smallint").alias("month"),
        F.year(t).cast("smallint").alias("year"),
        F.dayofyear(t).cast("smallint").alias("day_of_year"),
        (isodow(t) >= 6).alias("is_weekend"),
        is_dst(TIME, tz).alias("is_bst"),
        F.lit(False).alias("is_gb_holiday"),
        F.lit(False).alias("is_gb_holiday_resolved"),
    )


def dim_region(regional: DataFrame) -> DataFrame:
    """A3."""
    return regional.groupBy("region_id").agg(
        F.max("region_shortname").alias("region_shortname"),
        F.max("dno_region").alias("dno_region"),
        F.lit(False).alias("is_scoreable"),
        F.count(F.lit(1)).alias("observed_periods"),
    )


def fct_intensity_period(
    intensity: DataFrame,
    absent: DataFrame,
    as_of: Column,
    keys: Sequence[str] = (),
    plausible_max=C.PLAUSIBLE_MAX,
) -> DataFrame:
    """Actual, benchmark and lifecycle flags per period (P7 to P10, J2, T-3)."""
    facts = (
        intensity.withColumn("benchmark_error", signed_error("benchmark", "actual"))
        .withColumn(
            "is_matured", is_matured(TIME, "revision_count", "knowable_at_utc", as_of)
        )
        .withColumn("is_permanently_unscoreable", is_unscoreable("actual", TIME, as_of))
        .withColumn("benchmark_missing", F.col("benchmark").isNull())
        .withColumn("is_benchmark_plausible", plausible("benchmark", plausible_max))
        .withColumn("is_comparable", is_comparable("actual", "benchmark", plausible_max))
    )
    return flag_absent(facts, absent).withColumnRenamed(
        "is_known_absent", "is_known_absent_upstream"
    )


def fct_generation_mix(mix: DataFrame) -> DataFrame:
    """The long form, kept lazy: nothing consumes it stored."""
    return mix.select(text_key(iso_text(TIME), "fuel").alias("mix_key"), "*")


def mix_wide(mix: DataFrame, keys: Sequence[str] = (TIME,)) -> DataFrame:
    """A1: one row per period; a fixed list of columns, so one pass."""
    wide = [
        F.max(F.when(F.col("fuel") == f, F.col("perc"))).alias(f"{f}_perc")
        for f in C.WIDE_FUELS
    ]
    return mix.groupBy(*keys).agg(
        *wide,
        F.sum(F.when(F.col("is_low_carbon"), F.col("perc"))).alias("low_carbon_perc"),
        F.sum(F.when(F.col("is_fossil"), F.col("perc"))).alias("fossil_perc"),
        F.sum("perc").alias("total_perc"),
        F.count(F.lit(1)).alias("fuels_reported"),
        F.max("knowable_at_utc").alias("knowable_at_utc"),
    )


def fct_demand_period(demand: DataFrame) -> DataFrame:
    """Every vintage with its publication lag."""
    return demand.withColumn(
        "demand_key", text_key(iso_text(TIME), iso_text("publish_time_utc"))
    ).withColumn("publish_lag_minutes", lag_minutes("publish_time_utc", TIME))



def fct_weather_hour(weather: DataFrame) -> DataFrame:
    """Typed hourly weather with its text key; stored by accumulate-only upserts."""
    return weather.withColumn(
        "weather_hour_key", text_key("location_id", iso_text("hour_start_utc"))
    )


def fct_weather_period(weather_hour: DataFrame, spine: DataFrame) -> DataFrame:
    """Held over half hours; a view, as nothing needs it stored."""
    return align_hourly(weather_hour, spine).withColumn(
        "weather_key", text_key(iso_text(TIME), "location_id")
    )


def weather_wide(
    weather_period: DataFrame,
    locations: Sequence[str] = C.FEATURE_LOCATIONS,
    measures: Sequence[str] = (
        "wind_speed_100m_kmh",
        "temperature_2m_c",
        "shortwave_radiation_wm2",
    ),
) -> DataFrame:
    """A2: one row per period, ``measure__location`` columns from a fixed list."""
    cells = [
        F.max(F.when(F.col("location_id") == place, F.col(m))).alias(f"{m}__{place}")
        for m in measures
        for place in locations
    ]
    kept = weather_period.where(F.col("location_id").isin(*locations))
    return kept.groupBy(TIME).agg(*cells)


def mart_absent_periods(windows: DataFrame, spine: DataFrame) -> DataFrame:
    """Known absences as periods."""
    from tidemark.operators.joins import expand_windows

    return expand_windows(windows, spine).select(TIME, "source", "reason", "verified_on")


def incremental_since(target: DataFrame, as_of: Column, days: int = C.LOOKBACK_DAYS) -> Column:
    """T-1: start of the rebuilt window, counted back from the newest past period."""
    newest = target.agg(F.max(TIME).alias("m")).select(F.least("m", as_of)).scalar()
    return F.coalesce(newest, F.lit("1970-01-01").cast("timestamp")) - F.expr(
        f"interval {days} days"
    )


def merged(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """T-1, T-2: the target after delete and insert by key."""
    kept = target.join(updates.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(updates)
