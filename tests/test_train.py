"""The boosted model, its split and its intervals."""

import pytest
from conftest import at
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.plans import train as TR
from tidemark.plans.register import validate_register
from tidemark.session import scratch_dir


def frame(spark, origins=40, keys=("s",)):
    rows = []
    for o in range(origins):
        for h in range(1, 9):
            for k in keys:
                x = (o * 7 + h) % 13
                rows.append((k, at(o * 48), at(o * 48 + h), h, float(x), None if x == 3 else x * 2.0,
                             x * 3.0 + h + (o % 5)))
    return spark.createDataFrame(
        rows, "series_key string, origin_utc timestamp, target_utc timestamp, horizon_periods int, "
        "f1 double, f2 double, y double")


@pytest.mark.parametrize("share, want", [(0.75, 240), (0.3, 96), (0.333, 106)])
def test_split_is_by_row_order(spark, share, want):
    out = TR.chronological_split(frame(spark), share)
    fit = out.where("is_fit")
    assert fit.count() == want
    last = fit.agg(F.max(F.struct("origin_utc", "horizon_periods"))).first()[0]
    first = out.where("not is_fit").agg(F.min(F.struct("origin_utc", "horizon_periods"))).first()[0]
    assert tuple(last) < tuple(first)


def test_intervals_never_cross_and_widen(spark):
    rows = frame(spark).withColumn("pred", F.col("y") + F.col("f1") - 6)
    bands = {g: {"q025": 5.0, "q10": -2.0, "q90": 2.0, "q975": -5.0} for g in ("H1", "H2")}
    raw = TR.raw_intervals(rows, bands)
    ordered = (F.col("q025") <= F.col("q10")) & (F.col("q10") <= F.col("q90")) & (F.col("q90") <= F.col("q975"))
    assert raw.count() == 320 and raw.where(~ordered).isEmpty()
    widths = TR.conformal_widths(raw).first().asDict()
    wide = TR.widened(raw, widths)
    report = TR.interval_report(wide).first()
    assert report["coverage_80"] >= 0.8 and report["coverage_95"] >= 0.95


def test_train_forecast_store_and_load(spark):
    data = frame(spark, keys=("s", "t"))
    model = TR.train(data, ["f1", "f2", "horizon_periods"], max_iter=5, max_depth=3, min_leaf=2, learning_rate=0.3)
    rows = data.withColumn("run_at_utc", F.col("origin_utc"))
    issued = TR.issue_model(model, rows, ["series_key"])
    assert issued.count() == data.count()
    checked = validate_register(issued, ["series_key", "model_version", "run_at_utc", "target_utc"])
    assert checked.where("violation is not null").isEmpty()
    path = scratch_dir(spark, "model")
    TR.save_model(spark, path, model, {"model_version": "x"}, TR.holdout_summary(model.forecast(data), F.lit(2.0)))
    again, card = TR.load_model(spark, path)
    assert card["model_version"] == "x" and card["holdout"]["H1"]["n"] > 0
    a = {r["row_hash"] for r in issued.collect()}
    b = {r["row_hash"] for r in TR.issue_model(again, rows, ["series_key"]).collect()}
    assert a == b


def test_banned_features_are_refused(spark):
    with pytest.raises(Exception, match="banned"):
        TR.fit_point(frame(spark).withColumn("actual", F.lit(1.0)), ["f1", "actual"])


def test_mase_needs_a_positive_scale(spark):
    rows = frame(spark).withColumn("pred", F.col("y") + 1)
    got = TR.holdout_summary(rows, F.lit(0.0)).first()["mase"]
    assert got != got
    assert TR.holdout_summary(rows, F.lit(2.0)).first()["mase"] == pytest.approx(0.5)
    assert set(C.QUANTILE_LEVELS) == {"q025", "q10", "q90", "q975"}
