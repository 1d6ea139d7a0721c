"""Point-in-time features (F6 to F9): only what was knowable at issue time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.metrics import mean
from tidemark.functions.scalar import (
    add_seconds,
    cyclic,
    effective_knowable,
    epoch,
    period_of_day,
    weekday_mon0,
)
from tidemark.operators.asof import asof_last, trailing_rows_mean
from tidemark.operators.ordering import TIME, explode_origins
from tidemark.session import written

KNOWN = "knowable_effective_utc"
MIX = ("wind_perc", "solar_perc", "low_carbon_perc")
_REACH_HOURS = max(*C.LAG_HOURS, *C.ROLLING_HOURS) + 24


class LeakageError(RuntimeError):
    """A value that could not have been known at issue time."""


def assert_knowable(df: DataFrame, run_at: Column, column: str = "knowable_at_utc") -> DataFrame:
    """raise if a row was not yet knowable; refuse a frame that cannot be checked."""
    if column not in df.columns:
        raise LeakageError(f"no {column} column, so the frame cannot be checked for leakage")
    late = df.where(F.col(column) > run_at).agg(
        F.count(F.lit(1)).alias("n"), F.max(column).alias("latest")
    ).first()
    if late["n"]:
        raise LeakageError(f"{late['n']} row(s) not knowable; the latest is {late['latest']}")
    return df


def knowable_inline(df: DataFrame, run_at: Column, column: str = "knowable_at_utc") -> DataFrame:
    """F6 inside the plan: the job fails on the first leaked row, without an extra pass."""
    if column not in df.columns:
        raise LeakageError(f"no {column} column, so the frame cannot be checked for leakage")
    check = F.assert_true(F.col(column) <= run_at, F.lit("row not knowable at issue time"))
    return df.where(check.isNull())


def assert_no_banned(df: DataFrame, banned: Sequence[str] = C.BANNED_FEATURES) -> DataFrame:
    """the target, the benchmark and the band label are not features."""
    present = sorted(set(df.columns) & set(banned))
    if present:
        raise LeakageError(f"banned feature column(s): {present}")
    return df


def with_effective_knowable(intensity: DataFrame) -> DataFrame:
    """The instant a value counts as known, reconstructed for backfilled rows."""
    if KNOWN in intensity.columns:
        return intensity
    if "knowable_is_reconstructed" not in intensity.columns:
        return intensity.withColumn(KNOWN, F.col("knowable_at_utc"))
    return intensity.withColumn(
        KNOWN, effective_knowable(TIME, "knowable_at_utc", "knowable_is_reconstructed")
    )


def calendar_features(targets: DataFrame, target: str = "target_utc") -> DataFrame:
    """Attributes of the target period, on the UTC clock."""
    sp, cp = cyclic(period_of_day(target), C.SEASON_DAY)
    sy, cy = cyclic(F.dayofyear(target), 365.25)
    dow = weekday_mon0(target)
    return (
        targets.withColumn("sin_period_of_day", sp)
        .withColumn("cos_period_of_day", cp)
        .withColumn("sin_day_of_year", sy)
        .withColumn("cos_day_of_year", cy)
        .withColumn("day_of_week", dow)
        .withColumn("is_weekend", (dow >= 5).cast("int"))
    )


def _distant_lags(series, issued, keys, run_offset: int, value: str) -> DataFrame:
    """Lags the bounded reach did not find, looked up at any distance.

    A day may serve a lag of h hours from the instant on at which its first row
    is knowable and the day lies wholly h hours before the anchor. So the newest
    day an issue time may use is the greatest of all days admitted up to it: a
    running maximum, taken inside calendar chunks with one carried row a chunk.
    No issue time meets more than its own chunk, however long a series is silent.
    The rows of that day follow.
    """
    keys = list(keys)
    open_lags = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(h).alias("h"),
                    F.col(f"intensity_lag_{h}h").isNull().alias("open"),
                )
                for h in C.LAG_HOURS
            ]
        ),
        lambda x: x["open"],
    )
    asks = (
        issued.select(*keys, "origin_utc", F.explode(open_lags).alias("__l"))
        .select(*keys, "origin_utc", F.col("__l.h").alias("h"))
        .withColumn("run_at", add_seconds("origin_utc", run_offset))
    )
    dated = series.withColumn("__day", F.to_date(TIME))
    days = dated.groupBy(*keys, "__day").agg(F.min(KNOWN).alias("__first"))
    over = F.date_add("__day", 1).cast("timestamp")
    admitted = days.select(
        *keys, "__day", "__first", over.alias("__over"),
        F.explode(F.array(*map(F.lit, C.LAG_HOURS))).alias("h"),
    ).withColumn("at", F.greatest("__first", add_seconds("__over", F.col("h") * 3600 + run_offset)))
    both = admitted.select(*keys, "h", "at", "__day").unionByName(
        asks.select(*keys, "h", F.col("run_at").alias("at"), "run_at", "origin_utc"), allowMissingColumns=True
    )
    both = both.withColumn("__chunk", F.date_trunc("week", "at"))
    group = [*keys, "h", "__chunk"]
    upto = Window.partitionBy(*group).orderBy("at", F.col("origin_utc").isNotNull())
    earlier = Window.partitionBy(*keys, "h").orderBy("__chunk")
    carry = (
        both.groupBy(*group).agg(F.max("__day").alias("__top"))
        .withColumn("__before", F.max("__top").over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
        .drop("__top")
    )
    best = (
        both.withColumn("__near", F.max("__day").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("origin_utc").isNotNull())
        .join(carry, group)
        .withColumn("__day", F.greatest("__near", "__before"))
        .where(F.col("__day").isNotNull())
        .select(*keys, "origin_utc", "h", "run_at", "__day")
    )
    found = (
        best.join(dated.select(*keys, "__day", TIME, value, KNOWN), [*keys, "__day"])
        .where(F.col(KNOWN) <= F.col("run_at"))
        .groupBy(*keys, "origin_utc", "h")
        .agg(F.max_by(value, TIME).alias("v"))
    )
    return found.groupBy(*keys, "origin_utc").agg(
        *[F.max(F.when(F.col("h") == h, F.col("v"))).alias(f"__far_{h}") for h in C.LAG_HOURS]
    )


def issue_features(
    intensity: DataFrame,
    issued: DataFrame,
    grid: C.Grid,
    keys: Sequence[str],
    run_offset_seconds: int,
    value: str = "actual",
) -> DataFrame:
    """Lags and rolling statistics at each issue time (W10, J14 of F8).

    Rows are sent to the issue times that can see them and aggregated there;
    what each map task sees of an issue time is merged before the shuffle. The
    result, one row per key and issue time, is written once, as the far look-up
    and the final join both read it. Issue times with nothing knowable are
    dropped, as they have no features.
    """
    keys = list(keys)
    seen = with_effective_knowable(intensity).where(F.col(value).isNotNull())
    seen = seen.select(*keys, TIME, value, KNOWN)
    near = explode_origins(seen, grid, TIME, -_REACH_HOURS * 3600, 0).where(
        F.unix_micros(KNOWN) <= F.unix_micros("origin_utc") + run_offset_seconds * 1000000
    )
    age = epoch("origin_utc") - epoch(TIME)
    aggs = []
    for h in C.LAG_HOURS:
        aggs.append(
            F.max_by(value, F.when(age >= h * 3600, F.col(TIME))).alias(f"intensity_lag_{h}h")
        )
    for h in C.ROLLING_HOURS:
        v = F.when(age < h * 3600, F.col(value))
        aggs.append(mean(v).alias(f"intensity_mean_{h}h"))
        aggs.append(F.stddev_samp(v.cast("double")).alias(f"intensity_std_{h}h"))
    reached = near.groupBy(*keys, "origin_utc").agg(*aggs)
    lined = written(issued.join(reached, [*keys, "origin_utc"], "left"), "issue-features")
    far = _distant_lags(seen, lined, keys, run_offset_seconds, value)
    out = lined.join(far, [*keys, "origin_utc"], "left")
    for h in C.LAG_HOURS:
        name = f"intensity_lag_{h}h"
        out = out.withColumn(name, F.coalesce(name, f"__far_{h}").cast("double")).drop(
            f"__far_{h}"
        )
    return out.where(F.col("intensity_lag_0h").isNotNull())


def mix_features(mix: DataFrame, issued: DataFrame, grid: C.Grid) -> DataFrame:
    """Mix of the last row at or before issue, and the 24 h mean of the wind share."""
    rows = mix.withColumn("__m", F.struct(*MIX))
    last = asof_last(rows, issued, [], "__m", "origin_utc", out="__last")
    recent = (
        explode_origins(mix, grid, TIME, -(24 * 3600 - 1), 0)
        .groupBy("origin_utc")
        .agg(mean(F.col("wind_perc")).alias("mix_wind_mean_24h"))
    )
    return last.join(recent, "origin_utc", "left").select(
        "origin_utc",
        *[F.col(f"__last.{c}").cast("double").alias(f"mix_{c}_at_issue") for c in MIX],
        "mix_wind_mean_24h",
    )


def _if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast a side whose row count the grid bounds; a plain join beyond the limit.

    Many series share few issue times, so a shuffle on those would be lopsided.
    """
    return F.broadcast(df) if rows <= limit else df


def build_features(
    targets: DataFrame,
    grid: C.Grid,
    intensity: DataFrame,
    mix: DataFrame,
    weather: DataFrame,
    keys: Sequence[str] = ("series_key",),
    run_offset_seconds: int = -C.EMBARGO_HOURS * 3600,
) -> DataFrame:
    """F8: features for targets with keys, origin_utc, target_utc and horizon.

    ``run_offset_seconds`` is the issue instant minus its anchor period: minus
    the embargo in training, zero or a little more when live. ``weather`` is the
    wide table. Mix and weather are shared by all series, filtered by period
    only.
    """
    keys = list(keys)
    issued = targets.select(*keys, "origin_utc").distinct()
    shared = targets.select("origin_utc").distinct()
    base = issue_features(intensity, issued, grid, keys, run_offset_seconds)
    base = base.join(
        _if_small(mix_features(mix, shared, grid), grid.count), "origin_utc", "left"
    )
    measures = [c for c in weather.columns if c != TIME]
    winds = [c for c in measures if c.startswith("wind_speed_100m_kmh__")]
    trail = trailing_rows_mean(weather, shared, winds)
    base = base.join(_if_small(trail, grid.count), "origin_utc", "left")
    first = int(grid.start.timestamp())
    span = (grid.count - 1) * grid.step_seconds + C.HORIZONS * C.STEP_SECONDS
    at_target = weather.where(
        F.col(TIME).between(
            F.timestamp_seconds(F.lit(first)), F.timestamp_seconds(F.lit(first + span))
        )
    ).select(
        F.col(TIME).alias("target_utc"), *[F.col(c).cast("double").alias(c) for c in measures]
    )
    rows = calendar_features(targets).withColumnRenamed("horizon", "horizon_periods")
    rows = rows.join(base, [*keys, "origin_utc"]).join(
        _if_small(at_target, span // C.STEP_SECONDS + 1), "target_utc", "left"
    )
    for c in winds:
        rows = rows.withColumn(f"ramp_{c}", F.col(c) - F.col(f"trailing_{c}")).drop(
            f"trailing_{c}"
        )
    return rows


def build_dataset(
    grid: C.Grid,
    intensity: DataFrame,
    mix: DataFrame,
    weather: DataFrame,
    keys: Sequence[str] = ("series_key",),
    embargo_hours: int = C.EMBARGO_HOURS,
) -> DataFrame:
    """features with their realised label ``y``; null labels are dropped."""
    step = C.STEP_SECONDS
    known = intensity.where(F.col("actual").isNotNull())
    targets = (
        explode_origins(known, grid, TIME, step, C.HORIZONS * step)
        .select(
            *keys,
            "origin_utc",
            F.col(TIME).alias("target_utc"),
            F.col("actual").cast("double").alias("y"),
        )
        .withColumn("horizon", ((epoch("target_utc") - epoch("origin_utc")) / step).cast("int"))
    )
    return build_features(
        targets, grid, intensity, mix, weather, keys, -embargo_hours * 3600
    )


def feature_columns(df: DataFrame, keys: Sequence[str] = ("series_key",)) -> list[str]:
    outside = {*keys, "y", "target_utc", "origin_utc"}
    return [c for c in df.columns if c not in outside]
