"""Issuing forecasts into the register."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import add_seconds, horizon_group, is_finite, iso_text, text_key
from tidemark.operators.asof import asof_last, seasonal_asof
from tidemark.operators.ordering import TIME, grid_frame
from tidemark.plans.calibrate import bands_wide

CHAMPION = "B1_seasonal_naive_q_v1"
PERSISTENCE = "B0_persistence_v1"
PUBLISHED = "published_benchmark"
GBT = "G2_gbt_v1"
QS = list(C.QUANTILE_LEVELS)
NUM = "decimal(8,3)"
FINE = "decimal(18,6)"  # takes doubles first, so that rounding to NUM is decimal


def issue_targets(
    series: DataFrame,
    grid: C.Grid,
    keys: Sequence[str],
    run_offset_seconds: int = 0,
    horizons: int = C.HORIZONS,
) -> DataFrame:
    """Each key x issue time x horizon. Targets that have begun are left out.

    The grid's times are anchors, the periods that contain the issue instants.
    """
    if keys:
        first, step = int(grid.start.timestamp()), grid.step_seconds
        rows = (
            series.select(*keys)
            .distinct()
            .withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(grid.count - 1))))
            .withColumn("origin_utc", F.timestamp_seconds(F.lit(first) + F.col("__k") * step))
            .drop("__k")
        )
    else:
        rows = grid_frame(series.sparkSession, grid)
    return (
        rows.withColumn("run_at_utc", add_seconds("origin_utc", run_offset_seconds))
        .withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
        .withColumn("target_utc", add_seconds("origin_utc", F.col("horizon") * C.STEP_SECONDS))
        .where(F.col("target_utc") > F.col("run_at_utc"))
    )


def row_hash(keys: Sequence[str]) -> Column:
    """hash of the issued content, on fixed text forms of DECIMAL values."""
    forms = {"run_at": iso_text("run_at_utc"), "target": iso_text("target_utc")}
    for name in [*keys, "model_version", "horizon", "point", *QS]:
        forms[name] = F.col(name).cast("string")
    return F.sha2(F.to_json(F.struct(*[forms[f].alias(f) for f in sorted(forms)])), 256)


def as_register(rows: DataFrame, keys: Sequence[str], model: str, feature: Column) -> DataFrame:
    """Rows in register form: DECIMAL values, text id, both hashes."""
    keys = list(keys)
    shaped = (
        rows.withColumn("model_version", F.lit(model))
        .withColumn("point", F.col("point").cast(FINE).cast(NUM))
        .withColumn("feature_hash", F.sha2(feature, 256))
    )
    for q in QS:
        shaped = shaped.withColumn(
            q, (F.col(q) if q in rows.columns else F.lit(None)).cast(FINE).cast(NUM)
        )
    return shaped.select(
        text_key(*keys, "model_version", iso_text("run_at_utc"), iso_text("target_utc")).alias(
            "forecast_id"
        ),
        *keys,
        "model_version",
        "run_at_utc",
        "target_utc",
        "horizon",
        "point",
        *QS,
        "feature_hash",
        row_hash(keys).alias("row_hash"),
    )


def seasonal_points(series: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Champion points; targets without a knowable same-phase value are left out."""
    rows = seasonal_asof(
        series, targets, keys, {"point": C.SEASON_DAY}, known_until="run_at_utc"
    )
    return rows.where(is_finite("point"))


def issue_seasonal(
    series: DataFrame, targets: DataFrame, keys: Sequence[str], calibration: DataFrame
) -> DataFrame:
    """seasonal naive with the band's error offsets as quantiles."""
    keys = list(keys)
    bands = bands_wide(calibration, keys).withColumn(
        "horizon_group", horizon_group("band_low")
    )
    rows = seasonal_points(series, targets, keys).withColumn(
        "horizon_group", horizon_group("horizon")
    )
    rows = rows.join(bands.drop("band_low", "band_high"), [*keys, "horizon_group"], "left")
    for q in QS:
        rows = rows.withColumn(q, F.col("point") + F.col(f"{q}_offset").cast(FINE))
    rule = text_key(
        F.lit("most_recent_knowable_same_period_of_day"),
        F.lit(C.SEASON_DAY),
        iso_text("run_at_utc"),
        iso_text("target_utc"),
        F.col("point").cast(NUM),
    )
    return as_register(rows, keys, CHAMPION, rule)


def issue_persistence(series: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """the last value known at issue, on the champion's targets."""
    keys = list(keys)
    probes = targets.select(*keys, "run_at_utc").distinct()
    held = asof_last(series, probes, keys, "actual", "run_at_utc", out="point")
    rows = targets.join(
        held.select(*keys, "run_at_utc", "point"), [*keys, "run_at_utc"]
    ).where(is_finite("point"))
    rule = text_key(F.lit("persistence"), iso_text("run_at_utc"), F.col("point").cast(NUM))
    return as_register(rows, keys, PERSISTENCE, rule)


def issue_published(benchmark: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """the benchmark as published, on the champion's targets only.

    ``benchmark`` has keys, sp_start_utc and benchmark, as L6 returns it.
    """
    keys = list(keys)
    held = benchmark.select(
        *keys, F.col(TIME).alias("target_utc"), F.col("benchmark").alias("point")
    )
    rows = targets.join(held, [*keys, "target_utc"]).where(F.col("point").isNotNull())
    rule = text_key(F.lit("published"), iso_text("target_utc"))
    return as_register(rows, keys, PUBLISHED, rule)


def issued(*models: DataFrame) -> DataFrame:
    """Every model's rows of the run; a model without rows adds none."""
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return out


def issue_report(points: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Rows written per model, zero for a model that issued nothing."""
    spark = points.sparkSession
    names = spark.createDataFrame([(m,) for m in expected], "model_version string")
    counts = points.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "model_version", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )
