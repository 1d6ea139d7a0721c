from datetime import datetime, timedelta, timezone

import pytest

from tidemark.session import local_session

UTC = timezone.utc
START = datetime(2024, 1, 1, tzinfo=UTC)
HALF = timedelta(minutes=30)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="tidemark-tests")
    yield session
    session.stop()


def at(position: int) -> datetime:
    """The instant of a position on the half-hour axis."""
    return START + position * HALF


@pytest.fixture(scope="session")
def positional(spark):
    """4,000 half hours whose value is their own position."""
    from pyspark.sql import functions as F

    return spark.range(4000).select(
        F.lit("s").alias("series_key"),
        F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("id") * 1800).alias(
            "sp_start_utc"
        ),
        F.col("id").cast("double").alias("actual"),
        F.col("id").cast("double").alias("benchmark"),
        F.lit(True).alias("is_comparable"),
    )
