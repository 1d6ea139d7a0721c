"""Request windows no longer than a feed accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import add_seconds, epoch


def request_windows(
    df: DataFrame,
    span_seconds: int,
    window_from: str = "window_from_utc",
    window_to: str = "window_to_utc",
    clamp_to: Column | None = None,
) -> DataFrame:
    """Contiguous [from, to) chunks; none where from >= to.

    ``clamp_to`` ends the windows of feeds that only look back.
    """
    to = F.col(window_to) if clamp_to is None else F.least(F.col(window_to), clamp_to)
    lo, hi = epoch(window_from), F.unix_timestamp("__to")
    return (
        df.withColumn("__to", to)
        .where(F.col(window_from) < F.col("__to"))
        .withColumn(
            "__s", F.explode(F.sequence(lo, hi - 1, F.lit(span_seconds).cast("long")))
        )
        .withColumn("chunk_from_utc", F.timestamp_seconds("__s"))
        .withColumn(
            "chunk_to_utc", F.least(add_seconds("chunk_from_utc", span_seconds), F.col("__to"))
        )
        .drop("__s", "__to")
    )
