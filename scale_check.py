"""Operators on generated series at two sizes, one key holding a third of the landing.

    python scale_check.py 2500000 10000000

prints seconds per operator and size. Work that is linear takes about as many
times longer as there are more rows.
"""

from __future__ import annotations

import json
import sys
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import asof, audits, ordering, versions
from tidemark.operators.percentiles import exact_percentiles
from tidemark.plans import backtest, calibrate, features
from tidemark.session import local_session, scratch_dir

START = datetime(2020, 1, 1, tzinfo=timezone.utc)
YEARS_ROWS = 5 * 17_520
KEYS = ["series_key"]


def series(spark, rows: int) -> DataFrame:
    """Five years per series with 3% of the periods missing."""
    at = F.lit(int(START.timestamp())) + (F.col("id") % YEARS_ROWS) * 1800
    made = spark.range(rows).where(F.xxhash64("id") % 100 >= 3)
    return made.select(
        F.floor(F.col("id") / YEARS_ROWS).cast("int").alias("series_key"),
        F.timestamp_seconds(at).alias("sp_start_utc"),
        F.pmod(F.xxhash64("id", F.lit(7)), F.lit(40000)).cast("decimal(14,2)").alias("actual"),
        F.pmod(F.xxhash64("id", F.lit(9)), F.lit(40000)).cast("decimal(14,2)").alias("benchmark"),
        F.lit(True).alias("is_comparable"),
        F.lit(True).alias("is_matured"),
        F.timestamp_seconds(at + 3600).alias("knowable_at_utc"),
    )


def landing(spark, rows: int) -> DataFrame:
    """A third of the rows revise one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 100_003)
    payload = F.concat(F.lit('{"k": '), F.pmod(F.xxhash64("id"), F.lit(50)), F.lit("}"))
    return spark.range(rows).select(
        F.col("id").alias("landing_id"),
        key.alias("series_key"),
        F.lit(START).cast("timestamp").alias("sp_start_utc"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_hash"),
        F.timestamp_seconds(F.lit(int(START.timestamp())) + F.floor(F.col("id") / 20)).alias(
            "fetched_at_utc"
        ),
    )


def operators(data: DataFrame, land: DataFrame):
    grid = C.Grid(START + timedelta(days=1000), START + timedelta(days=1060), 24)
    keys = ["series_key", "sp_start_utc"]
    first = F.lit(START).cast("timestamp")
    nat = data.where(F.col("series_key") == 0)
    mix = nat.select(
        "sp_start_utc", *[F.col("actual").alias(c) for c in features.MIX]
    )
    weather = nat.select("sp_start_utc", F.col("actual").alias("wind_speed_100m_kmh__north_sea"))
    return {
        "latest_row": lambda: versions.latest_row(land, keys),
        "resolve": lambda: versions.resolve(land, keys),
        "scd2": lambda: versions.scd2(land, keys, ["payload"]),
        "conflicting_versions": lambda: versions.conflicting_versions(
            land, keys, ["payload"]
        ),
        "islands": lambda: ordering.islands(
            data.where(F.col("actual") < 20000).select(*keys), KEYS
        ),
        "rolling_24h": lambda: ordering.rolling_stats(data, KEYS, "actual", 24),
        "naive_scale_positional": lambda: ordering.naive_scale_positional(data, KEYS),
        "error_quantiles": lambda: calibrate.error_quantiles(
            data.where(F.col("sp_start_utc") >= first + F.expr("interval 4 years")), KEYS
        ),
        "exact_percentiles_one_group": lambda: exact_percentiles(
            data, [], "actual", {"p50": 0.5, "p95": 0.95, "p99": 0.99}
        ),
        "asof_last": lambda: asof.asof_last(
            data,
            data.select("series_key", (F.col("sp_start_utc") + F.expr("interval 7 minutes"))
                        .alias("stamp_utc")),
            KEYS,
            "actual",
        ),
        "backtest_60_origins": lambda: backtest.backtest(data, grid, KEYS),
        "training_features": lambda: features.build_dataset(grid, data, mix, weather, KEYS),
        "mix_sum_share": lambda: audits.share_of_total(
            data.groupBy("actual").count(), "count", "share"
        ),
    }


def main() -> None:
    spark = local_session("8", shuffle_partitions=32, app="tidemark-scale")
    out: dict[str, dict[int, float]] = {}
    for rows in [int(a) for a in sys.argv[1:]] or [2_500_000, 10_000_000]:
        path = scratch_dir(spark, f"scale-{rows}")
        series(spark, rows).write.parquet(f"{path}/series")
        landing(spark, rows).write.parquet(f"{path}/landing")
        data = spark.read.parquet(f"{path}/series")
        land = spark.read.parquet(f"{path}/landing")
        for name, build in operators(data, land).items():
            begun = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            out.setdefault(name, {})[rows] = round(time.perf_counter() - begun, 1)
            print(name, rows, out[name][rows], file=sys.stderr, flush=True)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
