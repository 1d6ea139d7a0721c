"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: dict[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Linear-interpolated percentiles, exact, without gathering a group in one task.

    A sketch with a guaranteed rank error brackets each wanted rank. The rows
    below a bracket are only counted; the rows inside, a share of about
    4/accuracy of the group, are counted per value and walked in order. The
    brackets are twice as wide as the sketch error; should one miss its rank all
    the same, the job fails rather than answer wrongly.
    """
    keys = list(keys)
    names = list(levels)
    eps = 2.0 / accuracy
    marks = []
    for n in names:
        marks += [max(0.0, levels[n] - eps), min(1.0, levels[n] + eps)]
    rows = df.where(F.col(value).isNotNull()).withColumn(
        "__x", F.col(value).cast("double")
    )
    brackets = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__x").alias("__min"),
        F.max("__x").alias("__max"),
        F.percentile_approx("__x", marks, accuracy).alias("__m"),
    )
    # In a small group a bracket spans less than the rank rounding, so the whole
    # group is counted per value; at the ends of the scale the extremes are known.
    small = F.col("__n") < int(8 / eps)
    picks = [
        F.struct(
            F.lit(n).alias("level_name"),
            F.lit(levels[n]).alias("level"),
            F.when(small | F.lit(marks[2 * i] <= 0), F.col("__min"))
            .otherwise(F.col("__m")[2 * i])
            .alias("lo"),
            F.when(small | F.lit(marks[2 * i + 1] >= 1), F.col("__max"))
            .otherwise(F.col("__m")[2 * i + 1])
            .alias("hi"),
        )
        for i, n in enumerate(names)
    ]
    brackets = brackets.select(*keys, F.struct("__n", F.array(*picks).alias("__b")).alias("__g"))
    if keys:
        # Counted per value and salted, so a group that holds most rows still
        # meets its bracket in many tasks.
        salt = F.pmod(F.xxhash64("__x"), F.lit(SALTS))
        counts = rows.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c"))
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt")
        joined = counts.withColumn("__salt", salt).join(
            brackets.select("*", salts), [*keys, "__salt"]
        )
    else:
        joined = rows.select("__x", F.lit(1).cast("long").alias("__c")).withColumn(
            "__g", brackets.scalar()
        )
    joined = joined.select(*keys, "__x", "__c", "__g.*")
    tagged = joined.select(*keys, "__n", "__x", "__c", F.explode("__b").alias("b")).where(
        F.col("__x") <= F.col("b.hi")
    )
    below = F.col("__x") < F.col("b.lo")
    counted = (
        tagged.withColumn("__y", F.when(~below, F.col("__x")))
        .groupBy(*keys, "__n", "b.level_name", "b.level", "__y")
        .agg(F.sum("__c").alias("c"))
    )
    upto = (
        Window.partitionBy(*keys, "level_name")
        .orderBy(F.col("__y").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    at = F.col("level") * (F.col("__n") - 1)
    low, high = F.floor(at), F.ceil(at)
    ranked = counted.withColumn("__last", F.sum("c").over(upto) - 1)
    picked = ranked.groupBy(*keys, "__n", "level_name", "level").agg(
        F.min(F.when((F.col("__last") >= low) & F.col("__y").isNotNull(), F.col("__y"))).alias("a"),
        F.min(F.when((F.col("__last") >= high) & F.col("__y").isNotNull(), F.col("__y"))).alias("b"),
        F.max(F.when(F.col("__y").isNull(), F.col("__last"))).alias("__below"),
        F.max("__last").alias("__upto"),
    )
    held = (F.coalesce("__below", F.lit(-1)) < F.floor(at)) & (F.col("__upto") >= F.ceil(at))
    exact = F.when(held, F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).otherwise(
        F.raise_error(F.lit("a bracket missed its rank")).cast("double")
    )
    return (
        picked.withColumn("__p", exact)
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("level_name") == n, F.col("__p"))).alias(n) for n in names])
    )
