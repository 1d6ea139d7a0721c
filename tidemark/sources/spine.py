"""The generated half-hour spine, which makes absence visible."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators.ordering import TIME, explode_grid


def spine(
    spark: SparkSession,
    start: datetime,
    as_of: datetime,
    forward_days: int = 60,
    step: int = C.STEP_SECONDS,
) -> DataFrame:
    """From ``start`` to the day of ``as_of`` plus the forward days, exclusive."""
    end = datetime(as_of.year, as_of.month, as_of.day, tzinfo=as_of.tzinfo) + timedelta(
        days=forward_days
    )
    lo = int(start.timestamp())
    n = max(0, -(-(int(end.timestamp()) - lo) // step))
    return spark.range(n).select(
        F.timestamp_seconds(F.lit(lo) + F.col("id") * step).alias(TIME)
    )


def spine_of(df: DataFrame, time: str = TIME, step: int = C.STEP_SECONDS) -> DataFrame:
    """Whole UTC days from the first to the last instant of a table."""
    bounds = df.agg(
        F.date_trunc("day", F.min(time)).alias("__from"),
        (F.date_trunc("day", F.max(time)) + F.expr("interval 1 day")).alias("__to"),
    )
    return explode_grid(bounds, "__from", "__to", step, TIME).select(TIME)
