"""The model registry as events: who was champion when.

A model is registered once; every evaluation of a challenger is an event, also
those that promote nothing. Roles are not stored: they follow from the events up
to an instant, so a forecast can be read as it was served.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_last

# The columns of both tables, and what an evaluation may end in.
MODEL = (
    "model_version string, model_family string, created_at_utc timestamp, code_commit string, "
    "train_from_utc timestamp, train_to_utc timestamp, uses_published_forecast boolean, notes string"
)
EVENT = (
    "promotion_id string, decided_at_utc timestamp, champion_version string, challenger_version string, "
    "outcome string, notes string"
)
OUTCOMES = ("promoted", "not_promoted", "inconclusive", "insufficient_sample")


def promotions(events: DataFrame) -> DataFrame:
    """The instants at which the champion changed, and to whom.

    Of promotions at one instant the one with the greatest id counts.
    """
    return (
        events.where(F.col("outcome") == "promoted")
        .groupBy("decided_at_utc")
        .agg(F.max_by("challenger_version", "promotion_id").alias("champion"))
    )


def champions_at(events: DataFrame, probes: DataFrame, stamp: str, out: str = "champion") -> DataFrame:
    """Probes plus the champion of their instant; null before the first promotion."""
    found = asof_last(promotions(events), probes, [], "champion", stamp, "decided_at_utc", "__c")
    return found.withColumn(out, F.col("__c")).drop("__c", "__c_utc")


def served_points(points: DataFrame, events: DataFrame, run: str = "run_at_utc") -> DataFrame:
    """The forecasts of whoever was champion when they were issued.

    The champion is looked up once an issue time, so the events never meet the
    points row by row; a promotion and a forecast of one instant: the new one.
    """
    champions = champions_at(events, points.select(run).distinct(), run, "model_version")
    return points.join(champions, [run, "model_version"], "left_semi")


def roles(models: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Every registered model with its role at an instant, and since when it has that role.

    The last promoted is champion; one that was champion before is retired, the
    others are challengers.
    """
    past = promotions(events).where(F.col("decided_at_utc") <= as_of)
    last = past.agg(F.max(F.struct("decided_at_utc", "champion"))).scalar()
    ruled = past.groupBy(F.col("champion").alias("model_version")).agg(
        F.max("decided_at_utc").alias("__since")
    )
    is_champion = F.col("model_version") == F.col("__last.champion")
    return (
        models.where(F.col("created_at_utc") <= as_of)
        .join(ruled, "model_version", "left")
        .withColumn("__last", last)
        .withColumn(
            "role",
            F.when(is_champion, "champion").when(F.col("__since").isNotNull(), "retired").otherwise("challenger"),
        )
        .withColumn(
            "role_since_utc",
            F.when(is_champion, F.col("__last.decided_at_utc"))
            .when(F.col("__since").isNotNull(), F.col("__last.decided_at_utc"))
            .otherwise(F.col("created_at_utc")),
        )
        .drop("__since", "__last")
    )


def event_violation(events: DataFrame, models: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """New events that break the registry's contract, each with the rule it breaks.

    Both models must be registered, the outcome known, and the champion named the
    one that held the role until then (null for the first).
    """
    known = models.select("model_version").distinct()
    history = events if stored is None else stored.unionByName(events)
    before = F.col("decided_at_utc") - F.expr("interval 1 microsecond")
    rows = champions_at(history, events.withColumn("__before", before), "__before", "__held").drop("__before")
    for c in ("champion_version", "challenger_version"):
        rows = rows.join(known.select(F.col("model_version").alias(c), F.lit(True).alias(f"__{c}")), c, "left")
    wrong = (
        F.when(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)), "unknown_outcome")
        .when(F.col("__challenger_version").isNull(), "challenger_not_registered")
        .when(F.col("champion_version").isNotNull() & F.col("__champion_version").isNull(), "champion_not_registered")
        .when(~F.col("champion_version").eqNullSafe(F.col("__held")), "not_the_champion")
    )
    return rows.withColumn("violation", wrong).where(F.col("violation").isNotNull()).select(*events.columns, "violation")
