"""The boosted model and its intervals on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import metrics as M
from tidemark.functions.scalar import horizon_group, sort4, text_key
from tidemark.operators.percentiles import exact_percentiles
from tidemark.plans.features import assert_no_banned
from tidemark.plans.issue import GBT, as_register
from tidemark.session import written

INTERVALS = (("q10", "q90", 0.80), ("q025", "q975", 0.95))


def chronological_split(df: DataFrame, share: float = 0.75) -> DataFrame:
    """``is_fit`` on the first share of the rows in (origin, horizon) order.

    Rows are counted per issue time and horizon; the running counts work on
    those counts, which depend on the grid and not on the number of series.
    """
    per_origin = df.groupBy("origin_utc").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("origin_utc").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_origin.withColumn("__o", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = df.groupBy("origin_utc", "horizon_periods").agg(F.count(F.lit(1)).alias("c"))
    within = Window.partitionBy("origin_utc").orderBy("horizon_periods")
    cells = (
        cells.withColumn("__c", F.sum("c").over(within))
        .join(starts.select("origin_utc", "__o"), "origin_utc")
        .withColumn("__upto", F.col("__o") + F.col("__c"))
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    marks = cells.select("origin_utc", "horizon_periods", "__upto")
    return (
        df.join(marks, ["origin_utc", "horizon_periods"])
        .withColumn("is_fit", F.col("__upto") <= F.floor(total * F.lit(share)))
        .drop("__upto")
    )


MISSING = -1.0e9  # below every real value, so one split sets missing rows apart


def _pipeline(features: Sequence[str], **gbt) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features"),
            GBTRegressor(
                featuresCol="features", labelCol="y", predictionCol="pred", seed=17, **gbt
            ),
        ]
    )


def prepared(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature columns as doubles; Spark's trees take no nulls, so those are marked."""
    outside = [c for c in df.columns if c not in features]
    return df.select(
        *outside,
        *[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(c) for c in features],
    )


def fit_point(
    train: DataFrame,
    features: Sequence[str],
    max_iter: int = 400,
    learning_rate: float = 0.06,
    max_depth: int = 7,
    min_leaf: int = 40,
) -> PipelineModel:
    """gradient boosting; banned columns are refused."""
    assert_no_banned(train.select(*features))
    stage = _pipeline(
        features, maxIter=max_iter, stepSize=learning_rate, maxDepth=max_depth,
        minInstancesPerNode=min_leaf,
    )
    return stage.fit(prepared(train, features))


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(prepared(df, features)).drop("features")


def residual_bands(fitted: DataFrame) -> DataFrame:
    """Quantiles of y - pred per horizon group: the raw interval offsets."""
    rows = fitted.withColumn("horizon_group", horizon_group("horizon_periods")).withColumn(
        "__e", F.col("y") - F.col("pred")
    )
    return exact_percentiles(rows, ["horizon_group"], "__e", C.QUANTILE_LEVELS)


def raw_intervals(scored: DataFrame, bands: dict[str, dict[str, float]]) -> DataFrame:
    """Point plus band offsets, put in order so that quantiles never cross."""
    rows = scored.withColumn("horizon_group", horizon_group("horizon_periods"))
    parts = []
    for n in C.QUANTILE_LEVELS:
        offset = F.lit(None).cast("double")
        for group, offsets in bands.items():
            offset = F.when(F.col("horizon_group") == group, F.lit(offsets[n])).otherwise(offset)
        parts.append(F.col("pred") + offset)
    return _in_order(rows, sort4(*parts)).drop("horizon_group")


def _in_order(rows: DataFrame, four: Column) -> DataFrame:
    rows = rows.withColumn("__q", four)
    for i, n in enumerate(C.QUANTILE_LEVELS):
        rows = rows.withColumn(n, F.col("__q")[i])
    return rows.drop("__q")


def conformal_widths(calibration: DataFrame) -> DataFrame:
    """How much each interval was too narrow on held-back rows; one row."""
    out = None
    for lo, hi, nominal in INTERVALS:
        miss = F.greatest(F.col(lo) - F.col("y"), F.col("y") - F.col(hi))
        rows = calibration.select(miss.alias("__s"))
        w = exact_percentiles(rows, [], "__s", {f"widen_{lo}": nominal})
        out = w if out is None else out.withColumn(f"widen_{lo}", w.scalar())
    return out


def widened(rows: DataFrame, widths: dict[str, float]) -> DataFrame:
    """intervals moved out by the conformal widths, order re-asserted."""
    w80, w95 = F.lit(widths["widen_q10"]), F.lit(widths["widen_q025"])
    return _in_order(
        rows,
        sort4(
            F.col("q025") - w95, F.col("q10") - w80, F.col("q90") + w80, F.col("q975") + w95
        ),
    )


def interval_report(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, width and pinball loss."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        M.coverage("y", "q10", "q90").alias("coverage_80"),
        M.coverage("y", "q025", "q975").alias("coverage_95"),
        M.width("q10", "q90").alias("width_80"),
        M.width("q025", "q975").alias("width_95"),
        M.pinball("y", "q10", 0.10).alias("pinball_10"),
        M.pinball("y", "q90", 0.90).alias("pinball_90"),
    )


def holdout_summary(scored: DataFrame, scale: Column) -> DataFrame:
    """Accuracy per horizon group on rows the model never saw."""
    rows = scored.withColumn("horizon_group", horizon_group("horizon_periods"))
    return rows.groupBy("horizon_group").agg(
        F.count(F.lit(1)).alias("n"),
        M.mae("y", "pred").alias("mae"),
        M.rmse("y", "pred").alias("rmse"),
        M.bias("y", "pred").alias("bias"),
        M.mase("y", "pred", scale).alias("mase"),
    )


@dataclass
class Model:
    """Two fitted pipelines and the eighteen numbers of their intervals."""

    point: PipelineModel
    early: PipelineModel
    features: list[str]
    bands: dict[str, dict[str, float]]
    widths: dict[str, float]

    def forecast(self, rows: DataFrame) -> DataFrame:
        """F16: point from one model, intervals from the other, for any feature rows."""
        spread = raw_intervals(predict(self.early, rows, self.features), self.bands)
        return predict(self.point, widened(spread, self.widths).drop("pred"), self.features)


def train(train_set: DataFrame, features: Sequence[str], **gbt) -> Model:
    """the point model and the intervals around it.

    The point model learns from the whole training set. The intervals come from
    a model of the earlier part and are widened on the later part, which that
    model never saw. What comes back to the driver is one row per horizon group
    and one row of widths.
    """
    features = list(features)
    # written, not cached: many passes read it, and a lost executor costs no recomputation
    split = written(chronological_split(train_set), "split")
    fit, cal = split.where("is_fit"), split.where(~F.col("is_fit"))
    point = fit_point(split, features, **gbt)
    early = fit_point(fit, features, **gbt)
    bands = {
        r["horizon_group"]: {n: r[n] for n in C.QUANTILE_LEVELS}
        for r in residual_bands(predict(early, fit, features)).collect()
    }
    widths = conformal_widths(raw_intervals(predict(early, cal, features), bands)).first().asDict()
    return Model(point, early, features, bands, widths)


def issue_model(model: Model, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F16: register rows from the trained model; ``rows`` also carry run_at_utc."""
    feature = text_key(
        *[F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in model.features]
    )
    out = model.forecast(rows.withColumn("__f", feature))
    out = out.withColumnRenamed("pred", "point").withColumn(
        "horizon", F.col("horizon_periods").cast("int")
    )
    return as_register(out, keys, GBT, F.col("__f"))


def save_model(
    spark: SparkSession, path: str, model: Model, card: dict, holdout: DataFrame | None = None
) -> None:
    """The fitted pipelines and a card with every number of the intervals."""
    model.point.write().overwrite().save(f"{path}/point")
    model.early.write().overwrite().save(f"{path}/early")
    full = dict(card, features=model.features, bands=model.bands, widths=model.widths)
    if holdout is not None:  # at most four rows
        full["holdout"] = {r["horizon_group"]: r.asDict() for r in holdout.collect()}
    text = json.dumps(full, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/card")


def load_model(spark: SparkSession, path: str) -> tuple[Model, dict]:
    card = json.loads(spark.read.text(f"{path}/card", wholetext=True).first()["value"])
    point, early = (PipelineModel.load(f"{path}/{n}") for n in ("point", "early"))
    return Model(point, early, card["features"], card["bands"], card["widths"]), card
