"""Captured feed responses to landing candidates.

A response is one line of a file or, with ``whole``, one file; the feed's maximum
window bounds its size either way. It is held as VARIANT, so the payload keeps
every field it came with and is written out in canonical form (sorted keys, nulls
kept).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import all_null, parse_iso


def read_documents(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole).withColumn(
        "fetched_at_utc", F.col("_metadata.file_modification_time")
    )


def _elements(docs: DataFrame, path: str = "$.data") -> DataFrame:
    doc = F.parse_json("value")
    return docs.select(
        "fetched_at_utc", F.explode(F.variant_get(doc, path, "array<variant>")).alias("e")
    )


def _text(path: str, v: str = "e") -> Column:
    return F.variant_get(F.col(v), path, "string")


def _record(df: DataFrame, keys: dict[str, Column], payload: str = "e") -> DataFrame:
    return df.select(
        *[c.alias(k) for k, c in keys.items()],
        F.to_json(F.col(payload)).alias("payload"),
        "fetched_at_utc",
    ).withColumn("payload_hash", F.sha2("payload", 256))


def read_intensity(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """One record per period."""
    return _record(
        _elements(read_documents(spark, path, whole)), {"sp_start_utc": parse_iso(_text("$.from"))}
    )


def read_genmix(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Same shape; the fuel array stays inside the payload."""
    return read_intensity(spark, path, whole)


def read_regional(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """S3: one record per period and region."""
    regions = _elements(read_documents(spark, path, whole)).select(
        "fetched_at_utc",
        parse_iso(_text("$.from")).alias("at"),
        F.explode(F.variant_get("e", "$.regions", "array<variant>")).alias("r"),
    )
    return _record(
        regions,
        {
            "sp_start_utc": F.col("at"),
            "region_id": F.variant_get("r", "$.regionid", "long"),
        },
        "r",
    )


def read_demand(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Keyed by period and publication time."""
    return _record(
        _elements(read_documents(spark, path, whole)),
        {
            "sp_start_utc": parse_iso(_text("$.startTime")),
            "publish_time_utc": parse_iso(_text("$.publishTime")),
        },
    )


def read_price(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Keyed by period and provider."""
    return _record(
        _elements(read_documents(spark, path, whole)),
        {
            "sp_start_utc": parse_iso(_text("$.startTime")),
            "data_provider": _text("$.dataProvider"),
        },
    )


def read_weather(
    spark: SparkSession,
    path: str,
    locations: Sequence[str] = C.LOCATIONS,
    variables: Sequence[str] = C.WEATHER_VARIABLES,
    whole: bool = False,
) -> DataFrame:
    """Parallel hourly arrays, one block per location by position.

    A response for one location may be a bare object. Hours whose variables are
    all null are dropped.
    """
    docs = read_documents(spark, path, whole)
    text = F.trim("value")
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    hourly = "struct<time:array<string>," + ",".join(f"{v}:array<double>" for v in variables) + ">"
    blocks = docs.select(
        "fetched_at_utc",
        F.posexplode(F.from_json(listed, f"array<struct<hourly:{hourly}>>")).alias("i", "b"),
    ).where(F.col("i") < len(locations))
    names = F.array(*[F.lit(n) for n in locations])
    rows = blocks.select(
        "fetched_at_utc",
        names[F.col("i")].alias("location_id"),
        F.explode(
            F.arrays_zip(
                F.col("b.hourly.time").alias("time"),
                *[F.col(f"b.hourly.{v}").alias(v) for v in variables],
            )
        ).alias("h"),
    ).where(~all_null(*[f"h.{v}" for v in variables]))
    payload = F.struct(
        F.col("h.time").alias("time"), "location_id", *[F.col(f"h.{v}").alias(v) for v in variables]
    )
    return rows.select(
        "location_id",
        parse_iso(F.concat(F.col("h.time"), F.lit("Z"))).alias("hour_start_utc"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"),
        "fetched_at_utc",
    ).withColumn("payload_hash", F.sha2("payload", 256))


SEED_SCHEMA = (
    "window_from_utc timestamp, window_to_utc timestamp, periods int, "
    "source string, reason string, verified_on date"
)


def read_seed(spark: SparkSession, path: str, schema: str = SEED_SCHEMA) -> DataFrame:
    """A seed CSV with a header and a fixed schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
