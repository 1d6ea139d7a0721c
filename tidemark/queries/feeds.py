"""Feeds: documents built from the tables, written as captured responses and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators.ordering import coalesce_periods
from tidemark.plans import staging
from tidemark.queries.common import query
from tidemark.queries.spine import KEYS, _WINDOWS, gaps_of_panel
from tidemark.session import scratch_dir
from tidemark.sources import feeds


def iso(c: str):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm'Z'")


def captured(t, rows, element, name: str) -> str:
    """One response per row and line, as a feed answers a request for that period."""
    path = scratch_dir(t.spark, name)
    doc = F.to_json(F.struct(F.array(element).alias("data")))
    rows.select(doc.alias("value")).write.text(path)
    return path


def with_ids(df, order):
    """Landing ids for rows of a freshly captured feed."""
    return df.withColumn("landing_id", F.xxhash64(*order))


def intensity_feed(t) -> str:
    element = F.struct(
        iso("sp_start_utc").alias("from"),
        F.struct(
            F.col("benchmark").cast("int").alias("forecast"),
            F.col("actual").cast("int").alias("actual"),
            F.lit("moderate").alias("index"),
        ).alias("intensity"),
    )
    return captured(t, t.hh(), element, "intensity")


@query(
    "s1_intensity_feed",
    "hh",
    """SELECT sp_start_utc, CAST(trunc(actual) AS INTEGER) AS actual,
    CAST(trunc(benchmark) AS INTEGER) AS benchmark, 1 AS revision_count FROM hh""",
)
def s1(t):
    landed = with_ids(feeds.read_intensity(t.spark, intensity_feed(t)), ["sp_start_utc"])
    return staging.stg_intensity(landed).select(
        "sp_start_utc", "actual", "benchmark", "revision_count"
    )


@query(
    "s2_genmix_feed",
    "mix",
    "SELECT sp_start_utc, fuel, perc, is_low_carbon, is_fossil FROM mix",
)
def s2(t):
    cell = F.struct("fuel", "perc")
    rows = t.mix().groupBy("sp_start_utc").agg(F.collect_list(cell).alias("generationmix"))
    element = F.struct(iso("sp_start_utc").alias("from"), "generationmix")
    landed = feeds.read_genmix(t.spark, captured(t, rows, element, "genmix"))
    return staging.stg_genmix(with_ids(landed, ["sp_start_utc"])).drop("knowable_at_utc")


@query(
    "s3_p3_regional_feed",
    "user_panel",
    """SELECT sp_start_utc, series_key AS region_id, 'R' || series_key AS region_shortname,
    'DNO' AS dno_region, CAST(trunc(benchmark) AS INTEGER) AS forecast, false AS is_scoreable
    FROM user_panel""",
)
def s3(t):
    region = F.struct(
        F.col("series_key").alias("regionid"),
        F.concat(F.lit("R"), F.col("series_key")).alias("shortname"),
        F.lit("DNO").alias("dnoregion"),
        F.struct(F.col("benchmark").cast("int").alias("forecast")).alias("intensity"),
    )
    element = F.struct(iso("sp_start_utc").alias("from"), F.array(region).alias("regions"))
    landed = feeds.read_regional(t.spark, captured(t, t.user_panel(), element, "regional"))
    return staging.stg_regional(with_ids(landed, ["sp_start_utc", "region_id"])).drop(
        "knowable_at_utc"
    )


@query(
    "s4_p4_demand_feed",
    "vintage",
    """SELECT sp_start_utc, CAST(date_trunc('second', publish_time_utc) AS TIMESTAMP)
      AS publish_time_utc, CAST(landing_id AS INTEGER) AS demand_indo_mw,
    CAST(user_id AS INTEGER) AS demand_itsdo_mw, CAST(sp_start_utc AS DATE) AS settlement_date,
    hour(sp_start_utc) * 2 + CASE WHEN minute(sp_start_utc) >= 30 THEN 1 ELSE 0 END
      AS settlement_period_no FROM vintage""",
)
def s4(t):
    element = F.struct(
        iso("sp_start_utc").alias("startTime"),
        F.date_format("publish_time_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishTime"),
        F.col("landing_id").alias("initialDemandOutturn"),
        F.col("user_id").alias("initialTransmissionSystemDemandOutturn"),
        F.to_date("sp_start_utc").cast("string").alias("settlementDate"),
        (F.hour("sp_start_utc") * 2 + (F.minute("sp_start_utc") >= 30).cast("int")).alias(
            "settlementPeriod"
        ),
    )
    landed = feeds.read_demand(t.spark, captured(t, t.vintage(), element, "demand"))
    return staging.stg_demand(
        with_ids(landed, ["sp_start_utc", "publish_time_utc", "payload"])
    ).drop("knowable_at_utc", "landing_id")


@query(
    "s5_p5_price_feed",
    "panel",
    """SELECT sp_start_utc, series_key AS data_provider,
    CAST(actual AS DECIMAL(10,2)) AS price_gbp_mwh,
    CAST(revision_count - 1 AS DECIMAL(14,3)) AS volume_mwh,
    revision_count = 1 AS is_zero_volume FROM panel""",
)
def s5(t):
    element = F.struct(
        iso("sp_start_utc").alias("startTime"),
        F.col("series_key").alias("dataProvider"),
        F.col("actual").alias("price"),
        (F.col("revision_count") - 1).alias("volume"),
    )
    landed = feeds.read_price(t.spark, captured(t, t.panel(), element, "price"))
    return staging.stg_price(with_ids(landed, ["sp_start_utc", "data_provider"])).drop(
        "knowable_at_utc"
    )


@query(
    "s6_p6_weather_feed",
    "weather_hour",
    """SELECT location_id, hour_start_utc, CAST(temperature_2m_c AS DECIMAL(6,2))
      AS temperature_2m_c, CAST(wind_speed_100m_kmh AS DECIMAL(12,2)) AS wind_speed_100m_kmh,
    CAST(shortwave_radiation_wm2 AS DECIMAL(8,2)) AS shortwave_radiation_wm2
    FROM weather_hour""",
)
def s6(t):
    """One response per day: a block per location by position, each with parallel arrays."""
    cols = {
        "time": F.date_format("hour_start_utc", "yyyy-MM-dd'T'HH:mm"),
        "temperature_2m": F.col("temperature_2m_c").cast("double"),
        "wind_speed_100m": F.col("wind_speed_100m_kmh").cast("double"),
        "shortwave_radiation": F.col("shortwave_radiation_wm2").cast("double"),
        "cloud_cover": F.lit(None).cast("double"),
    }
    hour = F.struct(*[c.alias(n) for n, c in cols.items()])
    per_place = (
        t.weather_hour()
        .groupBy(F.to_date("hour_start_utc").alias("day"), "location_id")
        .agg(F.array_sort(F.collect_list(hour)).alias("h"))
    )
    hourly = F.struct(*[F.col(f"h.{n}").alias(n) for n in cols])
    at = F.array_position(F.array(*[F.lit(p) for p in C.LOCATIONS]), F.col("location_id"))
    blocks = per_place.groupBy("day").agg(
        F.map_from_entries(F.collect_list(F.struct(at.cast("int"), F.struct(hourly.alias("hourly")))))
        .alias("m")
    )
    listed = F.transform(F.sequence(F.lit(1), F.lit(len(C.LOCATIONS))), lambda i: F.col("m")[i])
    path = scratch_dir(t.spark, "weather")
    blocks.select(F.to_json(listed).alias("value")).write.text(path)
    landed = feeds.read_weather(t.spark, path)
    typed = staging.stg_weather(with_ids(landed, ["location_id", "hour_start_utc"]))
    return typed.drop("knowable_at_utc", "cloud_cover_pct")


@query("s9_seed_windows", "panel", _WINDOWS)
def s9(t):
    """Outage windows written as a seed CSV and scanned with its schema."""
    path = scratch_dir(t.spark, "seed")
    rows = coalesce_periods(gaps_of_panel(t), KEYS)
    rows.select(*KEYS, "window_from_utc", "window_to_utc", "periods").write.csv(
        path, header=True
    )
    schema = "series_key string, window_from_utc timestamp, window_to_utc timestamp, periods long"
    return feeds.read_seed(t.spark, path, schema)
