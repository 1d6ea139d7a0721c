"""The register's contract, its scores, its seals, and the planner over it."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import START, UTC, at
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import instant
from tidemark.plans import calibrate as CAL
from tidemark.plans import issue as I
from tidemark.plans import planner as P
from tidemark.plans import register as R

KEYS = ["series_key"]
SCHEMA = (
    "forecast_id string, series_key string, model_version string, run_at_utc timestamp, "
    "target_utc timestamp, horizon int, point decimal(8,3), q025 decimal(8,3), q10 decimal(8,3), "
    "q90 decimal(8,3), q975 decimal(8,3), row_hash string"
)


def point(i=0, model="m", run=0, horizon=6, value=180.0, qs=(150, 160, 200, 210), target=None):
    qs = [None] * 4 if qs is None else [Decimal(q) for q in qs]
    goal = at(run + horizon) if target is None else target
    return (f"f{i:05d}", "s", model, at(run), goal, horizon, Decimal(str(value)), *qs, f"{i:064x}")


def points(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.mark.parametrize(
    "row, violation",
    [
        (point(), None),
        (point(qs=None), None),
        (point(target=at(-1)), "not_forward"),
        (point(target=at(0)), "not_forward"),
        (point(horizon=97), "horizon_out_of_range"),
        (point(qs=(200, 190, 150, 210)), "quantiles_not_ordered"),
    ],
)
def test_contract(spark, row, violation):
    assert R.validate_register(points(spark, row)).first()["violation"] == violation


def test_half_an_interval_is_a_violation(spark):
    row = list(point())
    row[8] = None
    assert R.validate_register(points(spark, tuple(row))).first()["violation"] == "quantiles_not_ordered"


def test_repeated_grain_is_a_violation(spark):
    got = R.validate_register(points(spark, point(1), point(2))).collect()
    assert [r["violation"] for r in got] == ["grain_not_unique"] * 2


# ---- issue ------------------------------------------------------------------
def test_issue_skips_begun_targets_and_orders_quantiles(spark, positional):
    cal = CAL.error_quantiles(positional, KEYS)
    grid = C.Grid.single(at(2000))
    targets = I.issue_targets(positional, grid, KEYS, run_offset_seconds=1800)
    rows = I.issue_seasonal(positional, targets, KEYS, cal)
    assert rows.count() == 95 and rows.agg(F.min("horizon")).first()[0] == 2
    assert R.validate_register(rows).where("violation is not null").isEmpty()
    # On a rising series the error over n days is 48 n, in every quantile of its band.
    got = {r["horizon"]: r["q10"] - r["point"] for r in rows.collect()}
    assert got[2] == got[48] == 48 and got[49] == got[96] == 96


def test_calibration_needs_more_than_eight_days(spark, positional):
    few = positional.where(F.col("actual") < 384)
    assert CAL.error_quantiles(few, KEYS).isEmpty()
    rows = CAL.error_quantiles(positional.where(F.col("actual") < 385), KEYS).collect()
    assert len(rows) == 16
    assert {(r["band_low"], r["n_samples"]) for r in rows} == {(1, 337), (7, 337), (25, 337), (49, 289)}


def test_newest_calibration_arrives_whole(spark):
    old = [("old", START, 1, 6, q, -1.0) for q in ("q025", "q10", "q90")] + [("old", START, 97, 99, "q10", 0.0)]
    offsets = (-61.478931, -28.10225, 27.999417, 60.3336)
    new = [("new", at(9), 1, 6, q, o) for q, o in zip(C.QUANTILE_LEVELS, offsets)]
    table = spark.createDataFrame(
        old + new, "calibration_run_id string, computed_at_utc timestamp, band_low int, "
        "band_high int, quantile_name string, offset double")
    got = CAL.newest_set(table).collect()
    assert {r["quantile_name"]: r["offset"] for r in got} == dict(zip(C.QUANTILE_LEVELS, offsets))
    assert not CAL.load_calibration(table, instant(at(9) + timedelta(days=3))).where("is_stale").count()
    assert CAL.load_calibration(table, instant(at(10) + timedelta(days=3))).where("is_stale").count() == 4


def test_row_hash_depends_on_content_only(spark, positional):
    targets = I.issue_targets(positional, C.Grid.single(at(2000)), KEYS)
    a = I.issue_persistence(positional, targets, KEYS)
    b = I.issue_persistence(positional.repartition(7), targets.repartition(3), KEYS)
    assert sorted(r["row_hash"] for r in a.collect()) == sorted(r["row_hash"] for r in b.collect())
    other = I.issue_persistence(positional.withColumn("actual", F.col("actual") + 1), targets, KEYS)
    assert not {r["row_hash"] for r in a.collect()} & {r["row_hash"] for r in other.collect()}


# ---- score ------------------------------------------------------------------
FACTS = (
    "series_key string, sp_start_utc timestamp, actual double, is_matured boolean, "
    "is_permanently_unscoreable boolean"
)


def test_scored_once_and_only_when_matured(spark):
    reg = points(spark, point(1, horizon=1), point(2, horizon=2), point(3, horizon=3, qs=None))
    facts = spark.createDataFrame(
        [("s", at(1), 170.0, True, False), ("s", at(2), 1.0, False, False), ("s", at(3), 300.0, True, False)],
        FACTS)
    scale = spark.createDataFrame([("s", 10.0)], "series_key string, scale double")
    first = R.score(reg, facts, scale)
    got = {r["forecast_id"]: r for r in first.collect()}
    assert set(got) == {"f00001", "f00003"}
    assert got["f00001"]["abs_error"] == 10 and got["f00001"]["in_80_interval"]
    assert got["f00001"]["pinball_10"] == pytest.approx(1.0)
    assert got["f00003"]["pinball_10"] is None and got["f00003"]["in_80_interval"] is None
    assert R.score(reg, facts, scale, first).isEmpty()


def test_accuracy_uses_periods_common_to_the_issue(spark):
    """A target some issued model missed counts for none; null intervals are misses."""
    reg = points(
        spark, point(1, "a", horizon=1), point(2, "a", horizon=2), point(3, "b", horizon=1, qs=None)
    )
    facts = spark.createDataFrame([("s", at(h), 180.0, True, False) for h in (1, 2)], FACTS)
    scale = spark.createDataFrame([("s", 0.0)], "series_key string, scale double")
    acc = {r["model_version"]: r for r in R.live_accuracy(reg, R.score(reg, facts, scale)).collect()}
    assert acc["a"]["n"] == acc["b"]["n"] == 1
    assert acc["a"]["coverage_80"] == 1.0 and acc["b"]["coverage_80"] == 0.0
    assert acc["a"]["mase"] is None and acc["b"]["interval_width_80"] is None


def test_equal_errors_share_a_rank(spark):
    rows = spark.createDataFrame(
        [("H1", m, 9, e, 1.0) for m, e in (("a", 1.0), ("b", 1.0), ("c", 2.0))],
        "horizon_group string, model_version string, n long, mae double, mase double")
    assert sorted(r["position"] for r in R.leaderboard(rows).collect()) == [1, 1, 3]


# ---- seals ------------------------------------------------------------------
def january(spark, n=40):
    return points(spark, *[point(i, run=i, horizon=1) for i in range(n)])


def test_flat_seal_is_the_hash_of_all_row_hashes(spark):
    import hashlib

    want = hashlib.sha256("".join(f"{i:064x}" for i in range(40)).encode()).hexdigest()
    row = R.month_seals(january(spark).repartition(5), algorithm="flat").first()
    assert (row["seal_hash"], row["row_count"], row["algorithm"]) == (want, 40, "flat")


def test_months_of_any_size_are_sealed_as_a_tree(spark):
    a = R.month_seals(january(spark).repartition(5)).first()
    b = R.month_seals(january(spark).repartition(2)).first()
    assert a == b and a["algorithm"] == "tree"
    assert R.month_seals(january(spark, 39)).first()["seal_hash"] != a["seal_hash"]
    with pytest.raises(ValueError, match="unknown seal"):
        R.month_seals(january(spark), algorithm="round")


def test_only_closed_unsealed_months_are_sealed(spark):
    reg = january(spark)
    assert R.seal_new_months(reg, None, instant(datetime(2024, 1, 20, tzinfo=UTC))).isEmpty()
    seals = R.seal_new_months(reg, None, instant(datetime(2024, 2, 1, tzinfo=UTC)))
    assert seals.count() == 1
    assert R.seal_new_months(reg, seals, instant(datetime(2024, 2, 1, tzinfo=UTC))).isEmpty()


@pytest.mark.parametrize("algorithm", ["flat", "tree"])
def test_audit_repeats_the_stored_algorithm_and_finds_any_change(spark, algorithm):
    reg = january(spark)
    seals = R.month_seals(reg, algorithm=algorithm)
    assert R.audit_seals(reg, seals).first()["passed"]
    other = seals.withColumn("algorithm", F.lit("tree" if algorithm == "flat" else "flat"))
    assert not R.audit_seals(reg, other).first()["passed"]
    assert not R.audit_seals(reg, seals.withColumn("algorithm", F.lit("round"))).first()["passed"]
    edited = reg.withColumn(
        "row_hash", F.when(F.col("horizon") + F.col("point") > 0, F.reverse("row_hash")))
    assert not R.audit_seals(edited, seals).first()["passed"]
    assert not R.audit_seals(reg.limit(39), seals).first()["passed"]
    assert not R.audit_seals(reg.limit(0), seals).first()["passed"]


# ---- planner ----------------------------------------------------------------
def run_of(spark, values, qs=True):
    rows = [
        point(i, horizon=i + 1, value=v, qs=(int(v) - 9, int(v) - 5, int(v) + 5, int(v) + 9) if qs else None)
        for i, v in enumerate(values)
    ]
    return points(spark, *rows)


def ask(spark, *rows):
    return spark.createDataFrame(
        [(i, "s", *r) for i, r in enumerate(rows)],
        "request_id int, series_key string, duration_hours double, within_hours double, "
        "appliance_kwh double")


def test_blocks_against_brute_force(spark):
    rng = random.Random(2)
    values = [rng.choice([50.0, 60.0, 70.0, 80.5]) for _ in range(96)]
    asked = [(w / 2, n / 2, 1.4) for w in (1, 2, 3, 7, 16) for n in (2, 16, 33, 96)]
    got = {r["request_id"]: r for r in P.plan(run_of(spark, values), ask(spark, *asked), digits=9).collect()}
    for i, (d, within, kwh) in enumerate(asked):
        w, n = int(d * 2), int(within * 2)
        search = values[:n]
        if w > n:
            assert got[i]["detail"] == "not enough forecast periods" and got[i]["best_mean"] is None
            continue
        means = [sum(search[k : k + w]) / w for k in range(n - w + 1)]
        best, worst = means.index(min(means)), means.index(max(means))
        row = got[i]
        assert row["min_horizon"] == best + 1 and row["max_horizon"] == best + w
        assert row["best_mean"] == pytest.approx(min(means))
        assert row["worst_mean"] == pytest.approx(max(means))
        assert row["worst_start_utc"].replace(tzinfo=UTC) == at(worst + 1)
        assert row["now_saving"] == pytest.approx(means[0] - min(means))
        assert row["average_saving"] == pytest.approx(sum(search) / n - min(means))
        assert row["now_saved_g"] == pytest.approx((means[0] - min(means)) * kwh)
        night = [k for k in range(n - w + 1) if at(k + 1).hour == 3 and at(k + 1).minute == 0]
        assert (row["overnight_mean"] is None) == (not night)
        if night:
            assert row["overnight_saving"] == pytest.approx(means[night[0]] - min(means))
        assert row["now_could_be_worse"] == (row["now_saving_low"] < 0)


def test_plan_without_intervals_has_no_range(spark):
    row = P.plan(run_of(spark, [90.0, 50.0, 70.0], qs=False), ask(spark, (0.5, 1.5, 2.0))).first()
    assert row["best_mean"] == 50.0 and row["now_saving"] == 40.0 and row["now_saving_pct"] == 44.4
    assert row["now_saving_low"] is None and row["now_could_be_worse"] is None


def test_hit_rate_needs_three_candidates(spark):
    rows = [("s", "m", at(run), at(run + h), h, float(v), float(a))
            for run, cells in ((0, [(1, 5, 9), (2, 6, 1), (3, 7, 2)]), (50, [(1, 1, 1), (2, 2, 2), (3, 3, 3)]),
                               (99, [(1, 1, 1), (2, 2, 2)]))
            for h, v, a in cells]
    scored = spark.createDataFrame(
        rows, "series_key string, model_version string, run_at_utc timestamp, target_utc timestamp, "
        "horizon int, point double, actual double")
    row = P.hit_rate(scored).first()
    assert (row["decisions"], row["hits"], row["hit_rate"]) == (2, 1, 0.5)
