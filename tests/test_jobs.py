"""The jobs end to end: captured feeds to marts, register, scores, seals and payloads."""

import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import UTC
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators.audits import run_audit
from tidemark.plans import register as R
from tidemark.plans import registry as G
from tidemark.plans.jobs import RegisterError, Warehouse
from tidemark.session import scratch_dir
from tidemark.sources import payloads
from tidemark.streaming.land import RetentionError

START = datetime(2024, 5, 10, tzinfo=UTC)
HALF = timedelta(minutes=30)
NOW = START + timedelta(days=20, hours=7, minutes=12)
ABSENT = "sp_start_utc timestamp, source string"


def feed(path, until, seed=4, bump=0):
    """Intensity from START to two days past ``until``; actuals up to ``until``."""
    rng, data, at = random.Random(seed), [], START
    while at < until + timedelta(days=2):
        base = 150 + 60 * ((at.hour - 12) / 12) ** 2 + rng.randint(-15, 15)
        actual = int(base) + bump if at + HALF <= until else None
        data.append({"from": at.strftime("%Y-%m-%dT%H:%MZ"),
                     "intensity": {"forecast": int(base) + 3, "actual": actual, "index": "moderate"}})
        at += HALF
    del data[100:103]
    path.mkdir(parents=True, exist_ok=True)
    (path / "f.json").write_text(json.dumps({"data": data}))
    return str(path)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("feeds")
    house = Warehouse(spark, scratch_dir(spark, "house"), START)
    absent = spark.createDataFrame([], ABSENT)
    house.ingest("ci_intensity", feed(tmp / "a", NOW), NOW, "r1", whole=True)
    house.build(NOW, absent)
    house.calibrate(NOW, "c1")
    first = house.issue(NOW)
    return house, absent, tmp, first


def test_ingest_again_writes_nothing(built):
    house, _, tmp, _ = built
    again = house.ingest("ci_intensity", str(tmp / "a"), NOW + timedelta(minutes=1), "r2", whole=True)
    assert again.rows_read > 900 and again.rows_written == 0
    assert house.ingest("ci_regional", "nowhere", NOW, "r3") is None


def test_gaps_become_one_window(built):
    house, absent, _, _ = built
    rows = house.gaps(NOW, absent, 30).collect()
    assert len(rows) == 1 and rows[0]["periods"] == 3
    assert rows[0]["chunk_to_utc"] - rows[0]["chunk_from_utc"] == 3 * HALF


def test_issue_counts_and_repeats(built):
    house, _, _, first = built
    by_model = {r[0]: r[1] for r in house.points().groupBy("model_version").count().collect()}
    assert by_model == {"B1_seasonal_naive_q_v1": 96, "B0_persistence_v1": 96, "published_benchmark": 96}
    assert first == sum(by_model.values())
    assert house.issue(NOW) == 0


def test_a_crossed_quantile_refuses_the_run(built):
    house, _, _, _ = built
    bad = house.points().withColumn("q10", F.col("q975") + 1)
    with pytest.raises(RegisterError, match="quantiles_not_ordered"):
        house.register(bad.drop("issue_month"))


def test_scores_seals_and_payloads(spark, built):
    house, absent, tmp, _ = built
    later = NOW + timedelta(days=4)
    house.ingest("ci_intensity", feed(tmp / "b", later), later, "r4", whole=True)
    house.build(later, absent)
    assert house.score(later) == 0  # revised this minute, so not trusted yet
    later += timedelta(hours=7)
    house.build(later, absent)
    assert house.score(later) == 288
    assert house.score(later) == 0
    acc = {(r["model_version"], r["horizon_group"]): r for r in house.accuracy().collect()}
    assert acc[("published_benchmark", "H4")]["n"] == acc[("B0_persistence_v1", "H4")]["n"] == 48
    assert 2 <= acc[("published_benchmark", "H1")]["mae"] <= 4
    assert house.seal(later) == 1 and house.seal(later) == 0
    house.audit_register(later)
    out = scratch_dir(spark, "pages")
    assert set(house.publish(out, later, "abc").values()) == {"ok"}
    assert payloads.read_payload(spark, out, "leaderboard").count() == 12
    assert len(payloads.current(spark, out)["files"]) == 7
    plan = payloads.read_payload(spark, out, "plan").select("snapshot.params", "payload.*").first()
    assert json.loads(plan["params"]) == C.PLAN_DEFAULTS and plan["best_start_utc"]
    assert payloads.read_payload(spark, out, "forecast_current").count() == 96
    summary = house.backtest(C.Grid(START + timedelta(days=9), START + timedelta(days=18), 24), "bt1")
    assert {r[0] for r in summary.select("model").distinct().collect()} >= {"B0_persistence", "B2_weekly_naive"}


def test_an_old_forecast_is_scored_when_its_actual_comes_late(spark):
    house = Warehouse(spark, scratch_dir(spark, "late"), START)
    target = START + timedelta(days=1)
    columns = "forecast_id string, series_key string, run_at_utc timestamp, target_utc timestamp, " + "".join(
        f"{q} double, " for q in ("point", "q10", "q90", "q025", "q975")
    ) + "issue_month string"
    rows = [
        (f"f{i}", "national", START, at, 1.0, 0.0, 2.0, 0.0, 3.0, at.strftime("%Y-%m"))
        for i, at in enumerate([target, target + timedelta(days=1), target + timedelta(days=40)])
    ]
    spark.createDataFrame(rows, columns).write.partitionBy("issue_month").parquet(
        house.path("register", "reg_forecast_point")
    )

    def facts(*matured):
        spark.createDataFrame(
            [(at, 5.0, at in matured, False) for *_, at, _, _, _, _, _, _ in rows],
            "sp_start_utc timestamp, actual double, is_matured boolean, is_permanently_unscoreable boolean",
        ).write.mode("overwrite").parquet(house.path("marts", "fct_intensity_period"))

    facts(rows[0][3])
    assert house.score(target + timedelta(days=2)) == 1
    facts(*(r[3] for r in rows))
    late = target + timedelta(days=400)
    assert house.score(late) == 2 and house.score(late) == 0


def test_audits_name_what_is_missing(built):
    house, _, _, _ = built
    report = run_audit(house.audit_pack(NOW), house.path("audits", "now"))
    assert len(report) == 11
    assert report["A02_structural_gaps"]["rows"][0]["periods"] == 3
    assert report["B01_unscoreable_periods"]["ok"] and report["B02_conflicting_versions"]["ok"]
    assert not report["D01_demand_publication_lag"]["ok"]


def test_tampering_with_a_sealed_month_fails_the_audit(spark, built):
    house, _, _, _ = built
    forged = house.points().limit(1).withColumn("forecast_id", F.lit("forged")).drop("issue_month")
    forged = forged.withColumn("target_utc", F.col("target_utc") + F.expr("interval 1 minute"))
    house.register(forged)
    with pytest.raises(RegisterError, match="no longer match"):
        house.audit_register(NOW + timedelta(days=9))
    changes = spark.read.parquet(house.path("register", "reg_seal_changes"))
    assert changes.agg(F.sum(F.col("observed_count") - F.col("sealed_count"))).first()[0] == 1
    assert changes.count() == 1  # the part of the forged id is named
    with pytest.raises(RegisterError, match="no longer match"):
        house.audit_register(NOW + timedelta(days=10), whole=True)


def test_an_empty_first_scoring_leaves_no_table(spark, tmp_path):
    house = Warehouse(spark, scratch_dir(spark, "unscored"), START)
    house.ingest("ci_intensity", feed(tmp_path / "a", NOW), NOW, "r1", whole=True)
    house.build(NOW, spark.createDataFrame([], ABSENT))
    house.calibrate(NOW, "c1")
    house.issue(NOW)
    assert house.score(NOW) == 0 and house.table("register", "reg_forecast_score") is None
    assert house.accuracy().where("n > 0").isEmpty()
    # a folder without data files, as an earlier version left it, is no table either
    spark.createDataFrame([], "a int, p string").write.partitionBy("p").parquet(house.path("register", "reg_forecast_score"))
    assert house.score(NOW) == 0


def test_months_wait_only_for_forecasts_that_may_be_scored(spark):
    points = spark.createDataFrame(
        [("a", "s", START, "m1"), ("b", "s", START + HALF, "m1"), ("c", "s", START + 2 * HALF, "m2"), ("d", "s", START, "m3")],
        "forecast_id string, series_key string, target_utc timestamp, issue_month string",
    )
    facts = spark.createDataFrame(
        [("s", START + HALF, True)], "series_key string, sp_start_utc timestamp, is_permanently_unscoreable boolean"
    )
    scores = spark.createDataFrame([("a", "m1"), ("d", "m3")], "forecast_id string, issue_month string")
    assert [r[0] for r in R.waiting_months(points, scores, facts).collect()] == ["m2"]


def test_the_build_opens_only_files_of_its_look_back(spark, tmp_path):
    house = Warehouse(spark, scratch_dir(spark, "zones"), START)
    absent = spark.createDataFrame([], ABSENT)
    house.ingest("ci_intensity", feed(tmp_path / "a", NOW), NOW, "r1", whole=True)
    house.build(NOW, absent)
    later = NOW + timedelta(days=3)
    house.ingest("ci_intensity", feed(tmp_path / "b", later), later, "r2", whole=True)
    every = house.landing("ci_intensity")
    some = house.landing("ci_intensity", F.lit(NOW - timedelta(days=2)))
    days = lambda df: {f.split("day=")[1][:10] for f in df.inputFiles()}
    assert min(days(every)) == "2024-05-10" and min(days(some)) == "2024-05-28"
    assert some.count() < every.count()
    house.build(later, absent)
    order = ["landing_id", "sp_start_utc", "payload"]
    before = every.select(*order).orderBy("landing_id").collect()
    facts = sorted(house.facts().drop("day").collect(), key=str)
    assert house.compact("ci_intensity") == 2 and house.compact("ci_intensity") == 0
    after = house.landing("ci_intensity")
    assert after.select(*order).orderBy("landing_id").collect() == before
    assert len({f.split("batch_id=")[1].split("/")[0] for f in after.inputFiles()}) == 1
    # the same response again changes nothing after compaction either
    again = house.ingest("ci_intensity", str(tmp_path / "b"), later + timedelta(minutes=1), "r3", whole=True)
    assert again.rows_written == 0
    house.build(later, absent)
    assert sorted(house.facts().drop("day").collect(), key=str) == facts


def windowed(tmp, spec=None):
    """A capture that answers every window of the intensity feed with what ``feed`` holds of it."""
    whole = json.loads((tmp / "all" / "f.json").read_text())["data"]
    asked = []

    def capture(source, start, end):
        asked.append((source, start, end))
        if source == "ci_genmix":
            raise ConnectionError("no answer")
        if source != "ci_intensity":
            return None
        rows = [r for r in whole if start <= datetime.strptime(r["from"], "%Y-%m-%dT%H:%MZ").replace(tzinfo=UTC) < end]
        folder = tmp / f"w{len(asked)}"
        folder.mkdir()
        (folder / "f.json").write_text(json.dumps({"data": rows}))
        return str(folder)

    return capture, asked


def test_one_source_fails_and_the_others_land(spark, tmp_path):
    feed(tmp_path / "all", NOW)
    house = Warehouse(spark, scratch_dir(spark, "loop"), START)
    capture, asked = windowed(tmp_path)
    found = house.ingest_scheduled(NOW, capture, "r1", back_days=2, ahead_days=2, whole=True)
    assert found["ci_genmix"].startswith("failed: ConnectionError")
    assert found["ci_intensity"].startswith("read 19") and found["ex_demand"] == "read 0, written 0"
    # the weather feed takes three days at most
    assert [(b - a).days for s, a, b in asked if s == "om_forecast"] == [3, 1]
    log = {r["source"]: r["status"] for r in house.table("landing", "run_log").collect()}
    assert log == {"ci_intensity": "success", "ci_genmix": "failed", "ex_demand": "success", "om_forecast": "success"}
    again = house.ingest_scheduled(NOW + timedelta(minutes=1), capture, "r2", ["ci_intensity"], 2, 2, True)
    assert again["ci_intensity"].endswith("written 0")


def test_a_gap_heals_as_far_as_the_feed_goes(spark, tmp_path):
    feed(tmp_path / "all", NOW)  # three periods are missing upstream too
    house = Warehouse(spark, scratch_dir(spark, "heal"), START)
    capture, asked = windowed(tmp_path)
    house.ingest_scheduled(START + timedelta(days=1), capture, "r1", ["ci_intensity"], 1, 0, True)
    house.ingest_scheduled(START + timedelta(days=4), capture, "r2", ["ci_intensity"], 1, 0, True)
    absent = spark.createDataFrame([], ABSENT)
    before = len(asked)
    found = house.heal(START + timedelta(days=4), absent, capture, "r3", whole=True)
    assert found == {"missing": 96, "healed": 93, "is_partial": True} and len(asked) == before + 1
    left = house.heal(START + timedelta(days=4), absent, capture, "r4", whole=True)
    assert left == {"missing": 3, "healed": 0, "is_partial": True}
    runs = house.table("landing", "run_log").where("job = 'gapfill'").collect()
    assert {r["status"] for r in runs} == {"partial"}
    with pytest.raises(ValueError):
        house.missing(NOW, absent, "om_forecast")


def test_retention_needs_the_mart_and_reports_first(spark, tmp_path):
    house = Warehouse(spark, scratch_dir(spark, "keep"), START)
    house.ingest("ci_genmix", feed(tmp_path / "mix", NOW), NOW, "r1", whole=True)
    later = NOW + timedelta(days=20)
    assert house.prune("ci_intensity", later) == {"report": None, "folders": 0, "rows": 0}
    with pytest.raises(RetentionError, match="absent or empty"):
        house.prune("ci_genmix", later)
    dry = house.prune("ci_genmix", later, execute=False)
    assert dry["rows"] == 0 and dry["report"]["delete_count"] > 0
    house.landing("ci_genmix").select("sp_start_utc").withColumn("day", F.to_date("sp_start_utc")).write.partitionBy(
        "day").parquet(house.path("marts", "fct_mix_wide"))
    went = house.prune("ci_genmix", later)
    # the day of the cutoff stays whole
    assert went["folders"] == 10 and went["rows"] == 10 * 48 - 3
    assert house.landing("ci_genmix").count() == dry["report"]["total_count"] - went["rows"]
    assert house.prune("ci_genmix", later + timedelta(minutes=1))["folders"] == 0


def models(spark, *names):
    return spark.createDataFrame(
        [(n, "f", START, "c", None, None, False, None) for n in names], G.MODEL
    )


def events(spark, *rows):
    return spark.createDataFrame(
        [(i, START + timedelta(days=d), was, new, out, None) for i, d, was, new, out in rows], G.EVENT
    )


def test_promotions_change_who_is_served(spark):
    house = Warehouse(spark, scratch_dir(spark, "roles"), START)
    assert house.register_model(models(spark, "a", "b", "c")) == 3
    assert house.register_model(models(spark, "a")) == 0
    house.record_promotion(events(spark, ("p1", 1, None, "a", "promoted"), ("p2", 3, "a", "b", "inconclusive")))
    house.record_promotion(events(spark, ("p3", 5, "a", "b", "promoted")))
    at = lambda d: {r["model_version"]: r["role"] for r in house.models(START + timedelta(days=d)).collect()}
    assert at(4) == {"a": "champion", "b": "challenger", "c": "challenger"}
    assert at(5) == {"a": "retired", "b": "champion", "c": "challenger"}
    assert set(at(0.5).values()) == {"challenger"}
    points = spark.createDataFrame(
        [(m, START + timedelta(days=d)) for m in "abc" for d in (0, 2, 5, 6)], "model_version string, run_at_utc timestamp"
    )
    served = G.served_points(points, house.table("register", "reg_promotion_event"))
    day = F.datediff("run_at_utc", F.lit(START.date()))
    assert sorted((r["d"], r["model_version"]) for r in served.withColumn("d", day).collect()) == [
        (2, "a"), (5, "b"), (6, "b")]


@pytest.mark.parametrize("row, rule", [
    (("p9", 7, "a", "b", "maybe"), "unknown_outcome"),
    (("p9", 7, "a", "x", "promoted"), "challenger_not_registered"),
    (("p9", 7, "x", "b", "promoted"), "champion_not_registered"),
    (("p9", 7, "b", "a", "promoted"), "not_the_champion"),
])
def test_an_event_that_breaks_the_contract_is_refused(spark, row, rule):
    house = Warehouse(spark, scratch_dir(spark, "events"), START)
    house.register_model(models(spark, "a", "b"))
    house.record_promotion(events(spark, ("p1", 1, None, "a", "promoted")))
    with pytest.raises(RegisterError, match=rule):
        house.record_promotion(events(spark, row))
    assert house.table("register", "reg_promotion_event").count() == 1


def test_work_that_can_wait_stands_down_when_the_budget_is_spent(spark):
    house = Warehouse(spark, scratch_dir(spark, "ledger"), START)
    assert not house.stands_down(NOW)
    house.record_usage("ingest", NOW, 5, 80)
    house.record_usage("idle", NOW, 0, 0, queries=0)
    assert not house.stands_down(NOW, budget=100)
    house.record_usage("build", NOW, 5, 15)
    assert house.stands_down(NOW, budget=100)
    row = house.status(NOW, budget=100).first()
    assert row["transfer_state"] == "over" and row["warnings"] == ["transfer over", "no runs recorded"]
