"""The append-only register: contract, scoring, accuracy and seals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.metrics import pinball_loss
from tidemark.functions.scalar import horizon_group
from tidemark.operators.joins import scored_rows, unscored
from tidemark.operators.ordering import TIME
from tidemark.session import written
from tidemark.sources.tables import within

GRAIN = ("model_version", "run_at_utc", "target_utc")


# ---- contract (F26) ---------------------------------------------------------
def contract_violation() -> Column:
    """The first broken rule of a row, or null."""
    qs = [F.col(q) for q in C.QUANTILE_LEVELS]
    none = qs[0].isNull() & qs[1].isNull() & qs[2].isNull() & qs[3].isNull()
    ordered = (qs[0] <= qs[1]) & (qs[1] <= qs[2]) & (qs[2] <= qs[3])
    return (
        F.when(~(F.col("target_utc") > F.col("run_at_utc")), "not_forward")
        .when(~F.col("horizon").between(1, C.HORIZONS), "horizon_out_of_range")
        .when(~(none | F.coalesce(ordered, F.lit(False))), "quantiles_not_ordered")
    )


def validate_register(df: DataFrame, grain: Sequence[str] = GRAIN) -> DataFrame:
    """every row with its violation; a repeated grain is one too."""
    counts = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("__n"))
    return (
        df.join(counts, list(grain))
        .withColumn(
            "violation",
            F.coalesce(
                contract_violation(), F.when(F.col("__n") > 1, F.lit("grain_not_unique"))
            ),
        )
        .drop("__n")
    )


# ---- scoring (F20) ----------------------------------------------------------
def pending_scores(points, facts, scores=None, keys=("series_key",)) -> DataFrame:
    """Forecasts whose target has matured and that have no score yet."""
    ready = facts.where(
        F.col("is_matured")
        & F.col("actual").isNotNull()
        & ~F.col("is_permanently_unscoreable")
    ).select(*keys, F.col(TIME).alias("target_utc"), "actual")
    waiting = points if scores is None else unscored(points, scores)
    return waiting.join(ready, [*keys, "target_utc"])


#: The columns of a score.
SCORE = (
    "forecast_id string, actual double, abs_error double, sq_error double, pinball_10 double, "
    "pinball_90 double, in_80_interval boolean, in_95_interval boolean, scale double"
)


def waiting_months(points, scores, facts, keys=("series_key",), month="issue_month") -> DataFrame:
    """The issue months that hold a forecast which has no score and may get one.

    Counts per month come first, which read no other column; ids are compared
    only in months whose counts differ. A forecast whose target can never be
    scored is not waited for.
    """
    forecasts = points.groupBy(month).agg(F.count(F.lit(1)).alias("__n"))
    scored = scores.groupBy(month).agg(F.count(F.lit(1)).alias("__s"))
    unequal = forecasts.join(scored, month, "left").where("__n > coalesce(__s, 0)").select(month)
    never = facts.where("is_permanently_unscoreable").select(*keys, F.col(TIME).alias("target_utc"))
    here = within(points, unequal, month).select(*keys, "target_utc", "forecast_id", month)
    waiting = here.join(within(scores, unequal, month).select("forecast_id"), "forecast_id", "left_anti")
    return waiting.join(never, [*keys, "target_utc"], "left_anti").select(month).distinct()


def score(points, facts, scale, scores=None, keys=("series_key",), carry=()) -> DataFrame:
    """a score per matured forecast, once ever, with columns to ``carry`` from the forecast.

    Null intervals give null flags and null pinball losses. ``scale`` has one
    MASE denominator per key.
    """
    keys = list(keys)
    a = F.col("actual")
    error = F.col("point") - a
    rows = pending_scores(points, facts, scores, keys)
    rows = rows.join(scale, keys, "left") if keys else rows.withColumn("scale", scale.scalar())
    return rows.select(
        "forecast_id",
        "actual",
        F.abs(error).alias("abs_error"),
        (error * error).alias("sq_error"),
        pinball_loss(a, "q10", 0.10).alias("pinball_10"),
        pinball_loss(a, "q90", 0.90).alias("pinball_90"),
        a.between(F.col("q10"), F.col("q90")).alias("in_80_interval"),
        a.between(F.col("q025"), F.col("q975")).alias("in_95_interval"),
        F.round("scale", 4).alias("scale"),
        *carry,
    )


# ---- accuracy (A4, A5, W7, P16) ---------------------------------------------
def comparable_targets(points, scored, keys=("series_key",)) -> DataFrame:
    """A5: targets scored for every model that issued at that time."""
    at = [*keys, "run_at_utc"]
    issuing = points.groupBy(*at).agg(F.countDistinct("model_version").alias("__issued"))
    covered = scored.groupBy(*at, "target_utc").agg(
        F.countDistinct("model_version").alias("__scored")
    )
    return (
        covered.join(issuing, at)
        .where(F.col("__scored") == F.col("__issued"))
        .select(*at, "target_utc")
    )


def live_accuracy(points, scores, keys=("series_key",), by=()) -> DataFrame:
    """Accuracy per model and horizon group on identical periods.

    A missing interval counts as a miss, so coverage is 0 and not null for
    models that issue none. ``by`` adds key columns to the groups.
    """
    scored = scored_rows(points, scores).withColumn("width_80", F.col("q90") - F.col("q10"))
    same = comparable_targets(points, scored, keys)
    rows = scored.join(same, [*keys, "run_at_utc", "target_utc"], "left_semi")
    rows = rows.withColumn("horizon_group", horizon_group("horizon"))
    n = F.count(F.lit(1))

    def share(flag: str) -> Column:
        return F.round(F.sum(F.when(F.col(flag), 1).otherwise(0)) / n, 4)

    return rows.groupBy(*by, "model_version", "horizon_group").agg(
        n.alias("n"),
        F.round(F.sum("abs_error") / n, 3).cast("double").alias("mae"),
        F.round(F.sqrt((F.sum("sq_error") / n).cast("double")), 3).alias("rmse"),
        F.round(
            (F.sum("abs_error") / n).cast("double") / F.nullif(F.max("scale"), F.lit(0.0)), 4
        ).alias("mase"),
        F.round(F.sum("width_80") / F.count("width_80"), 2)
        .cast("double")
        .alias("interval_width_80"),
        share("in_80_interval").alias("coverage_80"),
        share("in_95_interval").alias("coverage_95"),
        F.min("target_utc").alias("first_target"),
        F.max("target_utc").alias("last_target"),
    )


def leaderboard(accuracy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Models ranked within a horizon group; the input has a row per model."""
    place = Window.partitionBy(*by, "horizon_group").orderBy("mae")
    return accuracy.select(
        *by, "horizon_group", "model_version", "n", "mae", "mase",
        F.rank().over(place).alias("position"),
    )


def accuracy_report(
    accuracy: DataFrame, model: str | None = None, min_n: int = C.MIN_PUBLISHABLE_N
) -> DataFrame:
    """Rows flagged for publication, with the totals beside each."""
    rows = accuracy if model is None else accuracy.where(F.col("model_version") == model)
    rows = rows.withColumn("publishable", F.col("n") >= min_n)
    totals = rows.agg(
        F.struct(
            F.sum("n").alias("total_scored_points"),
            F.bool_or("publishable").alias("any_publishable"),
        )
    )
    return rows.withColumn("__t", totals.scalar()).select(*rows.columns, "__t.*")


def register_size(points: DataFrame) -> DataFrame:
    """A23."""
    return points.agg(
        F.count(F.lit(1)).alias("forecasts"),
        F.countDistinct("model_version").alias("models"),
        F.min("run_at_utc").alias("first_issued"),
        F.max("run_at_utc").alias("last_issued"),
    )


def latest_runs(points, registry, keys=("series_key",)) -> DataFrame:
    """The champion's latest issue time."""
    from tidemark.operators.joins import champion_points

    return (
        champion_points(points, registry)
        .groupBy(*keys, "model_version")
        .agg(F.max("run_at_utc").alias("run_at_utc"))
    )


def current_forecast(points, registry, keys=("series_key",), first: int | None = None):
    """The champion's latest run, optionally its first horizons only."""
    rows = points.join(
        latest_runs(points, registry, keys), [*keys, "model_version", "run_at_utc"], "left_semi"
    )
    return rows if first is None else first_horizons(rows, first, keys)


def first_horizons(points: DataFrame, n: int, keys=("series_key",)) -> DataFrame:
    """K3: the first n horizons of each run; a run has at most 96 rows."""
    order = Window.partitionBy(*keys, "model_version", "run_at_utc").orderBy("horizon")
    return points.withColumn("__n", F.row_number().over(order)).where(
        F.col("__n") <= n
    ).drop("__n")


def newest(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """K2: the last n rows; each task keeps n candidates."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


# ---- seals (A25, F25) -------------------------------------------------------
ALGORITHMS = ("tree", "flat")


def month_seals(
    points: DataFrame, period: Column | None = None, algorithm: str = "tree"
) -> DataFrame:
    """One hash over every row hash of a UTC month.

    "tree" splits the rows by day and by sixteen bits of the id's digest; the
    hashes of a day's parts, in order, make the day's, and the days' the month's.
    No task holds more than a part, a day's part hashes or a month's day hashes,
    at any size. "flat" hashes one string of all row hashes in the order of
    forecast ids, in one task; it exists to check seals made that way. The seal
    row names its algorithm, and the audit repeats that one.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown seal algorithm {algorithm!r}")
    period = period if period is not None else F.date_trunc("month", "run_at_utc")
    rows = points.select(
        F.to_date(period).alias("period_month"),
        F.to_date("run_at_utc").alias("day"),
        F.substring(F.sha2("forecast_id", 256), 1, 4).alias("part"),
        "forecast_id",
        F.lower("row_hash").alias("h"),
    )
    n = F.count(F.lit(1)).alias("row_count")

    def joined(hashes: str, order: str) -> Column:
        return F.expr(f"sha2(listagg({hashes}, '') within group (order by {order}), 256)")

    if algorithm == "flat":
        seals = rows.groupBy("period_month").agg(n, joined("h", "forecast_id").alias("seal_hash"))
    else:
        total = F.sum("row_count").alias("row_count")
        parts = rows.groupBy("period_month", "day", "part").agg(n, joined("h", "forecast_id").alias("h"))
        days = parts.groupBy("period_month", "day").agg(total, joined("h", "part").alias("h"))
        seals = days.groupBy("period_month").agg(total, joined("h", "day").alias("seal_hash"))
    return seals.withColumn("algorithm", F.lit(algorithm))


# ---- the stored tree (A25, F25) ----------------------------------------------
def tree_rows(points: DataFrame, period: Column | None = None) -> DataFrame:
    """The rows of a seal, each with the part of its day it belongs to."""
    period = period if period is not None else F.date_trunc("month", "run_at_utc")
    return points.select(
        F.to_date(period).alias("period_month"),
        F.to_date("run_at_utc").alias("day"),
        F.substring(F.sha2("forecast_id", 256), 1, 4).alias("part"),
        "forecast_id",
        F.lower("row_hash").alias("h"),
    )


def _in_order(hashes: str, order: str) -> Column:
    return F.expr(f"sha2(listagg({hashes}, '') within group (order by {order}), 256)")


def _marks(rows: DataFrame) -> DataFrame:
    """What shows cheaply that a part moved: its count, its newest id and a sum free of order."""
    return rows.groupBy("period_month", "day", "part").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.max("forecast_id").alias("newest_id"),
        F.bit_xor(F.xxhash64("forecast_id", "h")).alias("mark"),
    )


def seal_tree(points: DataFrame, period: Column | None = None) -> DataFrame:
    """The seal of every period as a table of its levels.

    A row a part (level ``part``), a day and a period (``month``), each with its
    hash, count and, for parts, newest id and mark. The periods' hashes are those
    of ``month_seals`` by "tree". An audit reads it to hash again only what moved.
    """
    rows = tree_rows(points, period)
    hashed = rows.groupBy("period_month", "day", "part").agg(_in_order("h", "forecast_id").alias("hash"))
    parts = hashed.join(_marks(rows), ["period_month", "day", "part"])
    return _levels(written(parts, "parts"))


def _levels(parts: DataFrame) -> DataFrame:
    """Days and periods above hashed parts, and the parts."""
    total = F.sum("row_count").alias("row_count")
    days = parts.groupBy("period_month", "day").agg(total, _in_order("hash", "part").alias("hash"))
    months = days.groupBy("period_month").agg(total, _in_order("hash", "day").alias("hash"))
    out = parts.withColumn("level", F.lit("part"))
    for level, rows in (("day", days), ("month", months)):
        out = out.unionByName(rows.withColumn("level", F.lit(level)), allowMissingColumns=True)
    return out.select(
        "period_month", "level", "day", "part", "row_count", "newest_id", "mark", "hash"
    )


def changed_parts(points: DataFrame, tree: DataFrame, period: Column | None = None) -> DataFrame:
    """the parts of sealed periods that are no longer as sealed, with what was and what is.

    Parts are compared by count, newest id and mark, one hash aggregate without
    a sort; only the rows of parts where one of them moved are put in order and
    hashed. A part that was lost, or that is new in a sealed period, counts too.
    """
    grain = ["period_month", "day", "part"]
    sealed = tree.where("level = 'part'")
    periods = sealed.select("period_month").distinct()
    rows = tree_rows(points, period).join(periods, "period_month", "left_semi")
    was = sealed.select(*grain, *[F.col(c).alias(f"sealed_{c}") for c in ("row_count", "newest_id", "mark", "hash")])
    both = _marks(rows).join(was, grain, "full")
    same = [F.col(c).eqNullSafe(F.col(f"sealed_{c}")) for c in ("row_count", "newest_id", "mark")]
    moved = written(both.where(~(same[0] & same[1] & same[2])), "moved")
    again = (
        rows.join(moved.select(*grain), grain, "left_semi")
        .groupBy(*grain).agg(_in_order("h", "forecast_id").alias("hash"))
    )
    return (
        moved.join(again, grain, "left")
        .where(~F.col("hash").eqNullSafe(F.col("sealed_hash")))
        .select(
            *grain,
            F.coalesce("sealed_row_count", F.lit(0).cast("long")).alias("sealed_count"),
            F.coalesce("row_count", F.lit(0).cast("long")).alias("observed_count"),
            "sealed_hash",
            F.col("hash").alias("observed_hash"),
        )
    )


def audit_tree(points: DataFrame, tree: DataFrame, period: Column | None = None) -> DataFrame:
    """the outcome for every sealed period, and how many of its parts differ."""
    changed = changed_parts(points, tree, period).groupBy("period_month").agg(
        F.count(F.lit(1)).alias("changed_parts"),
        F.sum(F.col("observed_count") - F.col("sealed_count")).alias("more_rows"),
    )
    sealed = tree.where("level = 'month'").select(
        "period_month", F.col("hash").alias("seal_hash"), F.col("row_count").alias("expected_count")
    )
    none = F.lit(0).cast("long")
    return (
        sealed.join(changed, "period_month", "left")
        .withColumn("changed_parts", F.coalesce("changed_parts", none))
        .withColumn("observed_count", F.col("expected_count") + F.coalesce("more_rows", none))
        .withColumn("passed", F.col("changed_parts") == 0)
        .drop("more_rows")
    )


def seal_new_months(
    points: DataFrame, seals: DataFrame | None, as_of: Column, algorithm: str = "tree"
) -> DataFrame:
    """seals of closed months that have none yet."""
    closed = points.where(F.col("run_at_utc") < F.date_trunc("month", as_of))
    if seals is not None:
        month = F.to_date(F.date_trunc("month", "run_at_utc"))
        closed = closed.withColumn("period_month", month).join(
            seals.select("period_month"), "period_month", "left_anti"
        )
    return month_seals(closed, algorithm=algorithm).withColumn("sealed_at_utc", as_of)


def audit_seals(points: DataFrame, seals: DataFrame, period: Column | None = None) -> DataFrame:
    """every stored seal recomputed by its own algorithm.

    A differing hash or count fails, and so does a seal of an unknown algorithm.
    """
    period = period if period is not None else F.date_trunc("month", "run_at_utc")
    rows = points.withColumn("period_month", F.to_date(period))
    fresh = None
    for algorithm in ALGORITHMS:
        mine = seals.where(F.col("algorithm") == algorithm).select("period_month")
        again = month_seals(
            rows.join(mine, "period_month", "left_semi"), F.col("period_month"), algorithm
        )
        fresh = again if fresh is None else fresh.unionByName(again)
    fresh = fresh.select(
        "period_month",
        "algorithm",
        F.col("seal_hash").alias("observed_hash"),
        F.col("row_count").alias("observed_count"),
    )
    return (
        seals.select(
            "period_month",
            "algorithm",
            F.col("seal_hash").alias("expected_hash"),
            F.col("row_count").alias("expected_count"),
        )
        .join(fresh, ["period_month", "algorithm"], "left")
        .withColumn("observed_count", F.coalesce("observed_count", F.lit(0).cast("long")))
        .withColumn(
            "passed",
            F.col("expected_hash").eqNullSafe(F.col("observed_hash"))
            & (F.col("expected_count") == F.col("observed_count")),
        )
    )
