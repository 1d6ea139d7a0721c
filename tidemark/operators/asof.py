"""As-of lookups: the last value at or before an instant."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import add_seconds, epoch
from tidemark.operators.ordering import TIME, _CH, _chunk, ordinal

_UPTO = (Window.unboundedPreceding, Window.currentRow)


def asof_last(
    series: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    value: str,
    stamp: str = "stamp_utc",
    time: str = TIME,
    out: str = "asof_value",
    chunk_seconds: int = C.DAY_SECONDS,
) -> DataFrame:
    """Probes plus the last non-null value with time <= stamp, at any distance.

    Series rows and probes meet inside their calendar chunk; what lies further
    back arrives as one carried row per chunk.
    """
    keys = list(keys)
    hit = F.struct(F.col("__t"), F.col("__v"))
    rows = series.where(F.col(value).isNotNull()).select(
        *keys, F.col(time).alias("__t"), F.col(value).alias("__v")
    )
    asks = probes.select(
        *keys, F.col(stamp).alias("__t"), F.struct(*probes.columns).alias("__p")
    )
    both = rows.unionByName(asks, allowMissingColumns=True).withColumn(
        _CH, _chunk("__t", chunk_seconds)
    )
    found = F.when(F.col("__v").isNotNull(), hit)
    inside = (
        Window.partitionBy(*keys, _CH)
        .orderBy(F.col("__t"), F.col("__p").isNotNull())
        .rowsBetween(*_UPTO)
    )
    before = Window.partitionBy(*keys).orderBy(_CH).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        both.groupBy(*keys, _CH)
        .agg(F.max_by(hit, F.when(F.col("__v").isNotNull(), F.col("__t"))).alias("__edge"))
        .select(*keys, _CH, F.last("__edge", ignorenulls=True).over(before).alias("__carry"))
    )
    return (
        both.withColumn("__near", F.last(found, ignorenulls=True).over(inside))
        .where(F.col("__p").isNotNull())
        .join(carry, [*keys, _CH])
        .withColumn("__hit", F.coalesce("__near", "__carry"))
        .select("__p.*", F.col("__hit.__v").alias(out), F.col("__hit.__t").alias(f"{out}_utc"))
    )


def seasonal_asof(
    series: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    seasons: dict[str, int],
    value: str = "actual",
    target: str = "target_utc",
    known_until: str = "known_until_utc",
    time: str = TIME,
    steps: int = C.WALKBACK_STEPS,
) -> DataFrame:
    """The latest same-phase value knowable at issue, at most ``steps`` seasons back.

    A target's candidates and the series rows they can land on share the phase
    within the season, so one shuffle on (keys, phase) brings them together and
    the walk back is "last non-null" in time order. Longer seasons are split
    finer inside the same partitions and need no second shuffle.
    """
    keys = list(keys)
    base = gcd(*seasons.values()) * C.STEP_SECONDS
    rows = series.where(F.col(value).isNotNull()).select(
        *keys, F.col(time).alias("__t"), F.col(value).alias("__v")
    )
    asks = targets.select(*keys, F.struct(*targets.columns).alias("__p"))
    both = rows.unionByName(asks, allowMissingColumns=True)
    at = F.coalesce(F.col("__t"), F.col(f"__p.{target}"))
    both = both.withColumn("__phase", F.pmod(epoch(at), F.lit(base)))
    for out, season in sorted(seasons.items(), key=lambda kv: kv[1]):
        span = season * C.STEP_SECONDS
        ahead = F.unix_micros(f"__p.{target}") - F.unix_micros(f"__p.{known_until}")
        back = F.greatest(F.lit(1), F.ceil(ahead / F.lit(span * 1000000)))
        cand = F.coalesce(F.col("__t"), add_seconds(f"__p.{target}", -back * span))
        parts = [*keys, "__phase"]
        if span != base:
            both = both.withColumn(f"__phase_{out}", F.pmod(epoch(at), F.lit(span)))
            parts.append(f"__phase_{out}")
        walk = (
            Window.partitionBy(*parts)
            .orderBy(f"__c_{out}", F.col("__p").isNotNull())
            .rowsBetween(*_UPTO)
        )
        both = both.withColumn(f"__c_{out}", cand).withColumn(
            f"__h_{out}",
            F.last(
                F.when(F.col("__v").isNotNull(), F.struct("__t", "__v")), ignorenulls=True
            ).over(walk),
        )
    done = both.where(F.col("__p").isNotNull())
    picks = []
    for out, season in seasons.items():
        near = epoch(f"__c_{out}") - epoch(f"__h_{out}.__t") <= (
            (steps - 1) * season * C.STEP_SECONDS
        )
        picks.append(F.when(near, F.col(f"__h_{out}.__v")).alias(out))
    return done.select("__p.*", *picks)


def trailing_rows_mean(
    rows: DataFrame,
    anchors: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = (),
    n: int = C.RAMP_ROWS,
    stamp: str = "origin_utc",
    time: str = TIME,
) -> DataFrame:
    """Mean over the last n available rows at or before each anchor.

    Row-based, so gaps reach further back. The n positions are looked up by an
    equi-join on row position.
    """
    keys = list(keys)
    numbered = ordinal(rows, keys, "__pos", time)
    at = asof_last(numbered, anchors, keys, "__pos", stamp, time, "__last")
    wanted = at.where(F.col("__last").isNotNull()).select(
        *keys,
        stamp,
        F.explode(
            F.sequence(F.greatest(F.col("__last") - (n - 1), F.lit(1)), F.col("__last"))
        ).alias("__pos"),
    )
    return (
        wanted.join(numbered.select(*keys, "__pos", *cols), [*keys, "__pos"])
        .groupBy(*keys, stamp)
        .agg(
            *[
                (F.sum(c).cast("double") / F.count(c)).alias(f"trailing_{c}")
                for c in cols
            ]
        )
    )
