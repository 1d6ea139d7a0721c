"""Order-sensitive operators that never sort one whole series in one task.

A window over a series is split by calendar chunk: the work inside a chunk runs
in parallel, and one small row per chunk carries the state across chunk borders.
A series that holds a large part of the data therefore spreads over as many
tasks as it has chunks. ``keys`` may be empty for one national series. Key
columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.metrics import mean
from tidemark.functions.scalar import add_seconds, epoch

TIME = "sp_start_utc"
CHUNK_SECONDS = 30 * C.DAY_SECONDS
_CH = "__chunk"


def _chunk(time: str, seconds: int) -> Column:
    """The start of the chunk in epoch seconds."""
    at = epoch(time)
    return at - F.pmod(at, F.lit(seconds))


def explode_grid(df: DataFrame, start: str, end: str, step: int, out: str) -> DataFrame:
    """Grid instants in [start, end): first one row per day, then its steps.

    No array grows past a day's steps or the count of days.
    """
    per_day = C.DAY_SECONDS - C.DAY_SECONDS % step
    lo, hi = F.unix_timestamp(start), F.unix_timestamp(end)
    days = df.where(F.col(start) < F.col(end)).withColumn(
        "__d", F.explode(F.sequence(lo, hi - 1, F.lit(per_day).cast("long")))
    )
    return days.withColumn(
        out,
        F.explode(
            F.sequence(
                F.col("__d"),
                F.least(F.col("__d") + per_day, hi) - 1,
                F.lit(step).cast("long"),
            )
        ),
    ).withColumn(out, F.timestamp_seconds(out)).drop("__d")


def explode_origins(
    df: DataFrame, grid: C.Grid, time: str, lo: int, hi: int, out: str = "origin_utc"
) -> DataFrame:
    """Each row once per issue time o of the grid with lo <= time - o <= hi seconds.

    The issue times are found by arithmetic, so rows meet the issue times that
    look at them without any join.
    """
    step, n = grid.step_seconds, grid.count
    start = int(grid.start.timestamp())
    # Plain bounds first: they reach the scan, the arithmetic below does not.
    near = F.col(time).between(
        F.timestamp_seconds(F.lit(start + lo)),
        F.timestamp_seconds(F.lit(start + (n - 1) * step + hi)),
    )
    df = df.where(near)
    since = epoch(time) - F.lit(start)
    first = F.greatest(F.ceil((since - hi) / F.lit(step)), F.lit(0).cast("long"))
    last = F.least(F.floor((since - lo) / F.lit(step)), F.lit(n - 1).cast("long"))
    return (
        df.withColumn("__a", first)
        .withColumn("__b", last)
        .where(F.col("__a") <= F.col("__b"))
        .withColumn("__k", F.explode(F.sequence("__a", "__b")))
        .withColumn(out, F.timestamp_seconds(F.lit(start) + F.col("__k") * step))
        .drop("__a", "__b", "__k")
    )


def grid_frame(spark, grid: C.Grid, out: str = "origin_utc") -> DataFrame:
    """The issue times as rows (F1)."""
    start = int(grid.start.timestamp())
    return spark.range(grid.count).select(
        F.timestamp_seconds(F.lit(start) + F.col("id") * grid.step_seconds).alias(out)
    )


def origins(spark, grid: C.Grid, horizons: int = C.HORIZONS) -> DataFrame:
    """issue times x horizons with their target periods."""
    return (
        grid_frame(spark, grid)
        .withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
        .withColumn(
            "target_utc", add_seconds("origin_utc", F.col("horizon") * C.STEP_SECONDS)
        )
    )


# ---- carried windows --------------------------------------------------------
def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    adds: dict[str, Column],
    time: str = TIME,
    tie: Sequence[str] = (),
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Inclusive running sums per key in time order."""
    keys = list(keys)
    d = df.withColumn(_CH, _chunk(time, chunk_seconds))
    for name, add in adds.items():
        d = d.withColumn(name, add)
    inside = (
        Window.partitionBy(*keys, _CH)
        .orderBy(time, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys).orderBy(_CH).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        d.groupBy(*keys, _CH)
        .agg(*[F.sum(n).alias(n) for n in adds])
        .select(
            *keys, _CH,
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in adds],
        )
    )
    for name in adds:
        d = d.withColumn(name, F.sum(name).over(inside))
    d = d.join(carry, [*keys, _CH])
    for name in adds:
        d = d.withColumn(name, F.col(name) + F.col(f"__{name}")).drop(f"__{name}")
    return d.drop(_CH)


def ordinal(df, keys, out="pos", time=TIME, tie=(), chunk_seconds=CHUNK_SECONDS) -> DataFrame:
    """Row number per key in time order."""
    return running_sum(df, keys, {out: F.lit(1).cast("long")}, time, tie, chunk_seconds)


def _neighbour(df, keys, cols, out, time, tie, chunk_seconds, forward: bool) -> DataFrame:
    keys = list(keys)
    order = [time, *tie]
    d = df.withColumn(_CH, _chunk(time, chunk_seconds))
    inside = Window.partitionBy(*keys, _CH).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(_CH)
    payload = F.struct(*cols)
    edge = (F.min_by if forward else F.max_by)(payload, F.struct(*order))
    step = F.lead if forward else F.lag
    carry = (
        d.groupBy(*keys, _CH)
        .agg(edge.alias("__edge"))
        .select(*keys, _CH, step("__edge").over(across).alias("__carry"))
    )
    return (
        d.withColumn("__near", step(payload).over(inside))
        .join(carry, [*keys, _CH])
        .withColumn(out, F.coalesce("__near", "__carry"))
        .drop("__near", "__carry", _CH)
    )


def previous_row(df, keys, cols, out="prev", time=TIME, tie=(), chunk_seconds=CHUNK_SECONDS):
    """The preceding row of the key as a struct; null on the first."""
    return _neighbour(df, keys, cols, out, time, tie, chunk_seconds, forward=False)


def next_row(df, keys, cols, out="next", time=TIME, tie=(), chunk_seconds=CHUNK_SECONDS):
    """The following row of the key as a struct; null on the last."""
    return _neighbour(df, keys, cols, out, time, tie, chunk_seconds, forward=True)


# ---- spine, gaps ------------------------------------------------------------
def period_numbers(spine: DataFrame, local_date: str = "settlement_date_local") -> DataFrame:
    """Number and count within the local day (46, 48 or 50 rows)."""
    day = Window.partitionBy(local_date)
    return spine.withColumn(
        "settlement_period_no", F.row_number().over(day.orderBy(TIME)).cast("smallint")
    ).withColumn("periods_in_local_day", F.count(F.lit(1)).over(day).cast("smallint"))


def spine_steps(spine: DataFrame, time: str = TIME) -> DataFrame:
    """Seconds since the preceding spine row, null on the first."""
    return previous_row(spine, [], [time], time=time).select(
        time, (epoch(time) - epoch(F.col(f"prev.{time}"))).alias("step_seconds")
    )


def islands(missing, keys=(), step: int = C.STEP_SECONDS, time: str = TIME) -> DataFrame:
    """Consecutive periods grouped; ``gap_end_utc`` is the last missing period."""
    numbered = ordinal(missing, keys, "__n", time)
    return (
        numbered.withColumn("__island", epoch(time) - F.col("__n") * step)
        .groupBy(*keys, "__island")
        .agg(
            F.min(time).alias("gap_start_utc"),
            F.max(time).alias("gap_end_utc"),
            F.count(F.lit(1)).alias("periods"),
        )
        .withColumn("hours", F.round(F.col("periods") * step / 3600.0, 1))
        .drop("__island")
    )


def coalesce_periods(periods, keys=(), step: int = C.STEP_SECONDS, time: str = TIME):
    """Windows with an exclusive end; a new one where the step is exceeded."""
    before = previous_row(periods, keys, [time], time=time)
    broken = F.coalesce(
        (epoch(time) - epoch(F.col(f"prev.{time}")) > step).cast("long"), F.lit(1)
    )
    grouped = running_sum(before, keys, {"__w": broken}, time)
    return (
        grouped.groupBy(*keys, "__w")
        .agg(
            F.min(time).alias("window_from_utc"),
            add_seconds(F.max(time), step).alias("window_to_utc"),
            F.count(F.lit(1)).alias("periods"),
        )
        .drop("__w")
    )


# ---- lags and rolling frames ------------------------------------------------
def lag_rows(series, keys, value: str, k: int, out="lagged", time=TIME) -> DataFrame:
    """The value k available rows earlier; a self equi-join on row position."""
    pos = ordinal(series, keys, "__pos", time)
    back = pos.select(*keys, (F.col("__pos") + k).alias("__pos"), F.col(value).alias(out))
    return pos.join(back, [*keys, "__pos"], "left").drop("__pos")


def naive_scale_positional(series, keys, value="actual", season=C.SEASON_DAY) -> DataFrame:
    """Mean absolute difference to the row ``season`` rows earlier."""
    lagged = lag_rows(series, keys, value, season)
    return lagged.groupBy(*keys).agg(
        mean(F.abs(F.col(value) - F.col("lagged"))).alias("scale")
    )


def naive_scale_time(series, keys, as_of: Column, value="actual", years=C.SCALE_YEARS, time=TIME):
    """Mean absolute difference to the value exactly 24 h earlier, trailing years.

    Rows a whole number of days apart share a phase; within it the row 24 h
    earlier, when present, is the preceding one.
    """
    phase = Window.partitionBy(*keys, "__phase").orderBy(time)
    since = as_of - F.expr(f"interval {years} years")
    seen = (
        series.where(F.col(value).isNotNull() & (F.col(time) > since - F.expr("interval 1 day")))
        .withColumn("__phase", F.pmod(epoch(time), F.lit(C.DAY_SECONDS)))
        .withColumn("__pt", F.lag(time).over(phase))
        .withColumn("__pv", F.lag(value).over(phase))
        .where(F.col(time) > since)
        .where(epoch(time) - epoch("__pt") == C.DAY_SECONDS)
    )
    return seen.groupBy(*keys).agg(mean(F.abs(F.col(value) - F.col("__pv"))).alias("scale"))


def rolling_stats(series, keys, value: str, hours: int, time=TIME) -> DataFrame:
    """Mean and sample deviation over (t - hours, t] at every row.

    Rows are copied into the following chunk too, so each chunk holds the whole
    frame of its own rows and no chunk needs another.
    """
    span = hours * 3600
    copied = series.withColumn("__home", _chunk(time, span)).withColumn(
        _CH, F.explode(F.array(F.col("__home"), F.col("__home") + span))
    )
    frame = (
        Window.partitionBy(*keys, _CH).orderBy(epoch(time)).rangeBetween(-span + 1, 0)
    )
    return (
        copied.withColumn(f"mean_{hours}h", mean_over(value, frame))
        .withColumn(f"std_{hours}h", F.stddev_samp(F.col(value).cast("double")).over(frame))
        .where(F.col(_CH) == F.col("__home"))
        .drop(_CH, "__home")
    )


def mean_over(value: str, frame) -> Column:
    return F.sum(value).over(frame).cast("double") / F.count(value).over(frame)
