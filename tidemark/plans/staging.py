"""Typed views of landing. Each reads one landing table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import json_each, json_get, json_text, parse_iso
from tidemark.operators.versions import latest_row, resolve


def stg_intensity(
    landing: DataFrame,
    keys: Sequence[str] = ("sp_start_utc",),
    actual_path: str = "intensity.actual",
    benchmark_path: str = "intensity.forecast",
    value_type: str = "int",
) -> DataFrame:
    """Current actual and benchmark; the band label is dropped on purpose."""
    after = F.expr(f"interval {C.RECONSTRUCTED_AFTER_DAYS} days")
    return resolve(landing, keys).select(
        *keys,
        json_text("payload", actual_path, value_type).alias("actual"),
        json_text("payload", benchmark_path, value_type).alias("benchmark"),
        F.col("fetched_at_utc").alias("knowable_at_utc"),
        "first_seen_at_utc",
        "revision_count",
        (F.col("first_seen_at_utc") > F.col("sp_start_utc") + after).alias(
            "knowable_is_reconstructed"
        ),
    )


def unnest_mix(current: DataFrame, keys: Sequence[str], array_json: str) -> DataFrame:
    """One row per fuel of an already current mix row."""
    rows = json_each(
        current.withColumn("__j", F.col(array_json)), "__j", "struct<fuel:string,perc:string>"
    )
    fuel = F.col("item.fuel")
    return rows.select(
        *keys,
        fuel.alias("fuel"),
        F.col("item.perc").cast("decimal(5,2)").alias("perc"),
        F.col("fetched_at_utc").alias("knowable_at_utc"),
        fuel.isin(*C.LOW_CARBON_FUELS).alias("is_low_carbon"),
        fuel.isin(*C.FOSSIL_FUELS).alias("is_fossil"),
    )


def stg_genmix(landing: DataFrame, keys: Sequence[str] = ("sp_start_utc",)) -> DataFrame:
    """The fuel array of the current row, unnested."""
    current = latest_row(landing, keys).withColumn(
        "__mix", json_get("payload", "generationmix")
    )
    return unnest_mix(current, keys, "__mix")


def stg_regional(landing: DataFrame) -> DataFrame:
    """A forecast and no actual; never scoreable."""
    keys = ["sp_start_utc", "region_id"]
    return latest_row(landing, keys).select(
        *keys,
        json_text("payload", "shortname").alias("region_shortname"),
        json_text("payload", "dnoregion").alias("dno_region"),
        json_text("payload", "intensity.forecast", "int").alias("forecast"),
        F.col("fetched_at_utc").alias("knowable_at_utc"),
        F.lit(False).alias("is_scoreable"),
    )


def stg_demand(landing: DataFrame) -> DataFrame:
    """Every vintage stays; nothing is deduplicated."""
    return landing.select(
        parse_iso(json_text("payload", "startTime")).alias("sp_start_utc"),
        parse_iso(json_text("payload", "publishTime")).alias("publish_time_utc"),
        json_text("payload", "initialDemandOutturn", "int").alias("demand_indo_mw"),
        json_text("payload", "initialTransmissionSystemDemandOutturn", "int").alias(
            "demand_itsdo_mw"
        ),
        json_text("payload", "settlementDate", "date").alias("settlement_date"),
        json_text("payload", "settlementPeriod", "smallint").alias("settlement_period_no"),
        F.col("fetched_at_utc").alias("knowable_at_utc"),
        "landing_id",
    )


def stg_price(landing: DataFrame) -> DataFrame:
    """P5: zero-volume quotes are flagged, not filtered."""
    keys = ["sp_start_utc", "data_provider"]
    return latest_row(landing, keys).select(
        *keys,
        json_text("payload", "price", "decimal(10,2)").alias("price_gbp_mwh"),
        json_text("payload", "volume", "decimal(14,3)").alias("volume_mwh"),
        F.col("fetched_at_utc").alias("knowable_at_utc"),
        (json_text("payload", "volume", "decimal(38,9)") == 0).alias("is_zero_volume"),
    )


def stg_weather(landing: DataFrame) -> DataFrame:
    """Used on the archive, forecast and vintage tables, which are never mixed."""
    keys = ["location_id", "hour_start_utc"]
    return latest_row(landing, keys).select(
        *keys,
        json_text("payload", "temperature_2m", "decimal(6,2)").alias("temperature_2m_c"),
        json_text("payload", "wind_speed_100m", "decimal(12,2)").alias("wind_speed_100m_kmh"),
        json_text("payload", "shortwave_radiation", "decimal(8,2)").alias(
            "shortwave_radiation_wm2"
        ),
        json_text("payload", "cloud_cover", "decimal(5,2)").alias("cloud_cover_pct"),
        F.col("fetched_at_utc").alias("knowable_at_utc"),
    )
