"""Nothing is used before it was knowable: values name the period they came from."""

from datetime import datetime, timedelta

import pytest
from conftest import START, UTC, at
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import instant
from tidemark.operators import asof
from tidemark.operators.ordering import origins
from tidemark.plans import backtest as B
from tidemark.plans import features as FT

KEYS = ["series_key"]


def targets_at(spark, position, horizons=96):
    grid = C.Grid.single(at(position))
    return (
        origins(spark, grid, horizons)
        .withColumn("series_key", F.lit("s"))
        .withColumn("known_until_utc", F.col("origin_utc"))
    )


def seasonal(spark, series, position, season, horizons=96):
    rows = asof.seasonal_asof(series, targets_at(spark, position, horizons), KEYS, {"p": season})
    return {r["horizon"]: r["p"] for r in rows.collect()}


def test_persistence_holds_the_last_observable_value(spark, positional):
    rows = B.persistence(positional, targets_at(spark, 1000), KEYS).collect()
    assert {r["b0"] for r in rows} == {1000.0} and len(rows) == 96


def test_seasonal_never_reaches_past_issue(spark, positional):
    got = seasonal(spark, positional, 2000, 48)
    assert len(got) == 96 and max(got.values()) <= 2000
    assert all((2000 + h - v) % 48 == 0 for h, v in got.items())
    assert got[60] == 2060 - 2 * 48


def test_weekly_never_reaches_past_issue(spark, positional):
    got = seasonal(spark, positional, 2000, 336)
    assert all(v <= 2000 and (2000 + h - v) % 336 == 0 for h, v in got.items())


def test_seasonal_steps_over_a_missing_period(spark, positional):
    holed = positional.where(F.col("actual") != 2001 - 48)
    nulled = positional.withColumn(
        "actual", F.when(F.col("actual") != 2001 - 48, F.col("actual"))
    )
    for series in (holed, nulled):
        assert seasonal(spark, series, 2000, 48, 1)[1] == 2001 - 96


def test_seasonal_gives_up_after_fourteen_steps(spark, positional):
    def without(days):
        gone = [2001.0 - 48 * k for k in range(1, days + 1)]
        return positional.where(~F.col("actual").isin(gone))

    assert seasonal(spark, without(13), 2000, 48, 1)[1] == 2001 - 48 * 14
    assert seasonal(spark, without(14), 2000, 48, 1)[1] is None


def test_asof_reaches_any_distance(spark, positional):
    old = positional.where(F.col("actual") <= 10)
    probe = spark.createDataFrame(
        [("s", at(3999)), ("s", at(5)), ("s", START - timedelta(days=1))],
        "series_key string, stamp_utc timestamp",
    )
    got = [r["asof_value"] for r in asof.asof_last(old, probe, KEYS, "actual").orderBy("stamp_utc").collect()]
    assert got == [None, 5.0, 10.0]


def test_climatology_ends_at_the_build(spark, positional):
    grid = C.Grid.single(at(2000))
    profile = B.climatology_profile(positional, B.profile_builds(spark, grid, 0), KEYS)
    assert profile.count() > 0
    assert profile.agg(F.max("median")).first()[0] <= 2000


def test_climatology_is_empty_before_history(spark, positional):
    grid = C.Grid.single(START - timedelta(days=1))
    assert B.climatology_profile(positional, B.profile_builds(spark, grid, 0), KEYS).isEmpty()


def test_every_baseline_respects_the_embargo(spark, positional):
    grid = C.Grid(at(2000), at(2048 * 1), 24)
    rows = B.backtest(positional, grid, KEYS, 24).where(F.col("model") != "published_benchmark")
    late = rows.where(
        F.col("pred") > (F.unix_timestamp("origin_utc") - int(START.timestamp())) / 1800 - 48
    )
    assert rows.count() > 700 and late.isEmpty()


def test_month_profile_is_built_at_the_first_origin(spark):
    grid = C.Grid(datetime(2024, 1, 30, tzinfo=UTC), datetime(2024, 2, 3, tzinfo=UTC), 24)
    rows = B.profile_builds(spark, grid, 24).collect()
    assert {(r["origin_month"], r["cal_month"]) for r in rows} == {
        (202401, 1), (202401, 2), (202402, 2), (202402, 3)
    }
    jan = {r["until"] for r in rows if r["origin_month"] == 202401}
    assert jan == {int(datetime(2024, 1, 29, tzinfo=UTC).timestamp())}


# ---- guards -----------------------------------------------------------------
def guard_frame(spark, minutes):
    run_at = datetime(2024, 6, 1, tzinfo=UTC)
    rows = [(run_at + timedelta(minutes=m),) for m in minutes]
    return spark.createDataFrame(rows, "knowable_at_utc timestamp"), instant(run_at)


def test_guard_raises_on_a_leaked_row(spark):
    df, run_at = guard_frame(spark, [-60, 1])
    with pytest.raises(FT.LeakageError, match="not knowable"):
        FT.assert_knowable(df, run_at)
    with pytest.raises(Exception, match="not knowable at issue time"):
        FT.knowable_inline(df, run_at).collect()


def test_guard_passes_the_past(spark):
    df, run_at = guard_frame(spark, [-300, 0])
    assert FT.assert_knowable(df, run_at).count() == 2
    assert FT.knowable_inline(df, run_at).count() == 2


def test_guard_refuses_what_it_cannot_check(spark):
    with pytest.raises(FT.LeakageError, match="no knowable_at_utc"):
        FT.assert_knowable(spark.range(2), instant(START))


@pytest.mark.parametrize("banned", ["actual", "benchmark", "index"])
def test_banned_columns_are_refused(spark, banned):
    with pytest.raises(FT.LeakageError, match=banned):
        FT.assert_no_banned(spark.range(1).withColumnRenamed("id", banned))


# ---- features ---------------------------------------------------------------
def inputs(positional, lag_hours=1):
    intensity = positional.withColumn(
        "knowable_at_utc", F.col("sp_start_utc") + F.expr(f"interval {lag_hours} hours")
    )
    v = F.col("actual")
    mix = positional.select(
        "sp_start_utc", v.alias("wind_perc"), v.alias("solar_perc"), v.alias("low_carbon_perc")
    )
    weather = positional.select("sp_start_utc", v.alias("wind_speed_100m_kmh__north_sea"))
    return intensity, mix, weather


def features(spark, frames, position, offset=0, grid=None):
    grid = grid or C.Grid.single(at(position))
    targets = targets_at(spark, position).drop("known_until_utc")
    return FT.build_features(targets, grid, *frames, KEYS, offset)


def test_features_use_only_what_was_known(spark, positional):
    row = features(spark, inputs(positional), 2000).orderBy("horizon_periods").first()
    assert row["intensity_lag_0h"] == 1998  # knowable one hour later
    assert row["intensity_lag_24h"] == 1952
    assert row["intensity_lag_48h"] == 1904
    assert row["intensity_lag_168h"] == 1664
    assert row["intensity_mean_24h"] == pytest.approx((1953 + 1998) / 2)
    assert row["mix_wind_perc_at_issue"] == 2000
    assert row["mix_wind_mean_24h"] == pytest.approx((1953 + 2000) / 2)
    assert row["wind_speed_100m_kmh__north_sea"] == 2001
    assert row["ramp_wind_speed_100m_kmh__north_sea"] == pytest.approx(2001 - (1953 + 2000) / 2)


def test_training_sees_only_data_two_days_old(spark, positional):
    """Embargo and reconstructed publication add up: the recent lags coincide."""
    row = features(spark, inputs(positional, 24), 2000, -86400).first()
    assert {row[f"intensity_lag_{h}h"] for h in (0, 24, 48)} == {1904.0}
    assert row["intensity_mean_24h"] is None


def test_wide_and_narrow_reads_agree(spark, positional):
    frames = inputs(positional)
    since = F.col("sp_start_utc") >= F.lit(at(2000 - 14 * 48))
    narrow = tuple(f.where(since) for f in frames)
    a = features(spark, frames, 2000).orderBy("horizon_periods").collect()
    b = features(spark, narrow, 2000).orderBy("horizon_periods").collect()
    assert a and a == b


def test_lags_reach_across_a_long_outage(spark, positional):
    """Rows older than the bounded reach are still found, as an unbounded read would."""
    intensity, mix, weather = inputs(positional)
    holed = intensity.where((F.col("actual") < 1000) | (F.col("actual") > 1990))
    row = features(spark, (holed, mix, weather), 2000).first()
    assert row["intensity_lag_0h"] == 1998
    assert row["intensity_lag_24h"] == 999
    assert row["intensity_lag_168h"] == 999


def test_far_lags_respect_knowability(spark, positional):
    """A far row that became known only after issue is passed over."""
    intensity, mix, weather = inputs(positional)
    late = F.when(F.col("actual") == 999, F.lit(at(3000))).otherwise(F.col("knowable_at_utc"))
    holed = intensity.where((F.col("actual") < 1000) | (F.col("actual") > 1990)).withColumn(
        "knowable_at_utc", late
    )
    assert features(spark, (holed, mix, weather), 2000).first()["intensity_lag_168h"] == 998


def test_origins_without_anything_known_are_left_out(spark, positional):
    grid = C.Grid(START, at(48 * 4), 24)
    intensity, mix, weather = inputs(positional)
    rows = FT.build_dataset(grid, intensity, mix, weather, KEYS)
    first = rows.agg(F.min("origin_utc")).first()[0]
    assert first.replace(tzinfo=UTC) == at(96)
    assert len(FT.feature_columns(rows)) == 39 - 14 - 4


def test_live_issue_matches_training_columns(spark, positional):
    frames = inputs(positional)
    live = features(spark, frames, 2000, 600)
    trained = FT.build_dataset(C.Grid(at(2000), at(2048), 24), *frames, KEYS)
    assert FT.feature_columns(live) == FT.feature_columns(trained)
