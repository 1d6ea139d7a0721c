"""T-5, T-6: half-hour buckets and outage sessions; the same code for both modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket(
    events: DataFrame,
    aggs: Sequence,
    time: str = "ts",
    keys: Sequence[str] = (),
    width: str = "30 minutes",
    late: str | None = None,
) -> DataFrame:
    """T-5: tumbling buckets; ``late`` sets a watermark on a stream."""
    source = events if late is None else events.withWatermark(time, late)
    return (
        source.groupBy(*keys, F.window(time, width).alias("w"))
        .agg(*aggs)
        .withColumn("sp_start_utc", F.col("w.start"))
        .drop("w")
    )


def sessions(
    events: DataFrame,
    time: str = "sp_start_utc",
    keys: Sequence[str] = (),
    gap: str = "30 minutes",
    late: str | None = None,
) -> DataFrame:
    """T-6: neighbours within the gap share a session that ends one gap after its last."""
    source = events if late is None else events.withWatermark(time, late)
    return (
        source.groupBy(*keys, F.session_window(time, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("periods"))
        .select(
            *keys,
            F.col("w.start").alias("window_from_utc"),
            F.col("w.end").alias("window_to_utc"),
            "periods",
        )
    )
