"""Each assertion passes on good data, fails on a broken copy, and never passes on nothing."""

from datetime import datetime, timedelta

import pytest
from conftest import START, UTC, at
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import horizon_group, instant
from tidemark.operators import quality as Q
from tidemark.operators.audits import run_audit
from tidemark.plans import marts, status
from tidemark.session import scratch_dir
from tidemark.sources import payloads, runlog
from tidemark.sources.spine import spine


@pytest.fixture(scope="module")
def dim(spark):
    df = spine(spark, datetime(2023, 12, 1, tzinfo=UTC), datetime(2025, 1, 31, tzinfo=UTC), 1)
    return marts.dim_settlement_period(df).cache()


def test_clock_changes_of_a_good_and_a_broken_spine(dim):
    assert Q.check_clock_changes(dim).isEmpty() and Q.clock_changes(dim).count() == 1
    broken = dim.withColumn("settlement_date_local", F.to_date("sp_start_utc"))
    assert Q.check_clock_changes(broken).first()["non_48_day_count"] == 0


def test_periods_per_day(dim):
    assert Q.check_periods_per_day(dim).isEmpty()
    holed = dim.where(F.col("sp_start_utc") != F.lit(datetime(2024, 6, 1, 12, tzinfo=UTC)))
    assert Q.check_periods_per_day(holed).first()["n_periods"] == 47


def test_spine_step(dim):
    assert Q.check_spine_step(dim).isEmpty()
    holed = dim.where(F.col("sp_start_utc") != F.lit(datetime(2024, 6, 1, 12, tzinfo=UTC)))
    assert Q.check_spine_step(holed).first()["step_seconds"] == 3600


def test_nothing_checked_is_not_a_pass(spark, dim):
    good = Q.status_of("steps", Q.check_spine_step(dim), dim).first()
    none = Q.status_of("steps", Q.check_spine_step(dim.limit(0)), dim.limit(0)).first()
    assert good["passed"] and not none["passed"]


FACT = (
    "sp_start_utc timestamp, actual int, benchmark int, is_matured boolean, "
    "is_permanently_unscoreable boolean, is_known_absent_upstream boolean"
)


def test_matured_rows_have_an_actual(spark):
    ok = (at(0), 10, 10, True, False, False)
    bad = (at(1), None, 10, True, False, False)
    excused = (at(2), None, 10, True, False, True)
    df = spark.createDataFrame([ok, bad, excused], FACT)
    assert [r["sp_start_utc"].replace(tzinfo=UTC) for r in Q.check_matured_have_actual(df).collect()] == [at(1)]


def test_a_frozen_mart_is_noticed(spark):
    mart = spark.createDataFrame([(at(0), None, 10), (at(1), 5, 5)], "sp_start_utc timestamp, actual int, benchmark int")
    staged = spark.createDataFrame([(at(0), 99, 10), (at(1), 5, 5)], "sp_start_utc timestamp, actual int, benchmark int")
    assert Q.check_mart_is_current(mart, staged).count() == 1
    assert Q.check_mart_is_current(staged, staged).isEmpty()


def test_ranges_and_sums(spark):
    df = spark.createDataFrame([(1, 5, 100.0), (-1, 5, 100.4), (1, 20001, 99.4), (None, None, None)],
                               "actual int, benchmark int, total_perc double")
    assert Q.check_range(df, {"actual": (0, 2000), "benchmark": (0, 20000)}).count() == 2
    assert Q.check_sum(df).count() == 1


def test_generic_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert Q.check_unique(df, "k").first()["n"] == 2
    assert Q.check_not_null(df, "k", "v").collect()[0]["column"] == "v"
    assert Q.check_accepted(df, "v", ["a"]).first()["v"] == "b"
    assert Q.check_category_count(df.withColumnRenamed("k", "sp_start_utc"), 2).first()["fuels_reported"] == 1


def test_banned_columns_in_the_catalog(spark):
    spark.range(1).withColumnRenamed("id", "index_band").createOrReplaceTempView("has_band")
    spark.range(1).createOrReplaceTempView("has_none")
    found = {(r["table_name"], r["column_name"]) for r in Q.check_no_column(spark).collect()}
    assert ("has_band", "index_band") in found and len(found) == 1
    spark.catalog.dropTempView("has_band")


def test_lineage_looks_through_views(spark):
    path = scratch_dir(spark, "lineage")
    spark.range(3).write.parquet(f"{path}/stg_om_archive")
    spark.read.parquet(f"{path}/stg_om_archive").createOrReplaceTempView("stg_om_archive")
    spark.sql("select id * 2 as id from stg_om_archive").createOrReplaceTempView("middle")
    feature = spark.sql("select id + 1 as f from middle")
    with pytest.raises(Q.LineageError):
        Q.check_lineage(feature, ["stg_om_archive"])
    by_file = spark.read.parquet(f"{path}/stg_om_archive").select((F.col("id") + 1).alias("f"))
    with pytest.raises(Q.LineageError):
        Q.check_lineage(by_file, ["stg_om_archive"])
    assert Q.check_lineage(spark.range(3), ["stg_om_archive"]).count() == 3


def test_audits_run_by_prefix_and_survive_failures(spark):
    def broken():
        raise RuntimeError("no table")

    pack = {"A01_rows": lambda: spark.range(50), "A02_broken": broken, "B01_more": lambda: spark.range(2)}
    report = run_audit(pack, scratch_dir(spark, "audits"), "a0", show=5)
    assert set(report) == {"A01_rows", "A02_broken"} and report["A01_rows"]["n_rows"] == 50
    assert spark.read.parquet(report["A01_rows"]["path"]).count() == 50
    assert len(report["A01_rows"]["rows"]) == 5 and not report["A02_broken"]["ok"]


# ---- facts ------------------------------------------------------------------
def test_lifecycle_flags(spark):
    as_of = START + timedelta(days=10)
    rows = [
        # period, actual, benchmark, revisions, knowable
        (as_of - timedelta(hours=25), 5, 5, 1, as_of),  # one version, old enough
        (as_of - timedelta(hours=23), 5, 5, 1, as_of),  # too young
        (as_of - timedelta(hours=30), 5, 5, 2, as_of - timedelta(hours=5)),  # still moving
        (as_of - timedelta(hours=30), 5, 13579, 2, as_of - timedelta(hours=7)),  # settled, corrupt
        (as_of - timedelta(hours=30), None, 5, 1, as_of),  # never scoreable
        (as_of - timedelta(hours=2), None, 5, 1, as_of),  # pending
    ]
    df = spark.createDataFrame(
        rows, "sp_start_utc timestamp, actual int, benchmark int, revision_count long, knowable_at_utc timestamp"
    ).withColumn("n", F.monotonically_increasing_id())
    absent = spark.createDataFrame([(as_of - timedelta(hours=25),)], "sp_start_utc timestamp")
    got = marts.fct_intensity_period(df, absent, instant(as_of)).orderBy("n").collect()
    assert [r["is_matured"] for r in got] == [True, False, False, True, True, False]
    assert [r["is_permanently_unscoreable"] for r in got] == [False] * 4 + [True, False]
    assert [r["is_comparable"] for r in got] == [True, True, True, False, False, False]
    assert [r["is_known_absent_upstream"] for r in got] == [True] + [False] * 5
    assert got[4]["benchmark_error"] is None


def test_horizon_groups_at_their_borders(spark):
    df = spark.createDataFrame([(h,) for h in (1, 6, 7, 24, 25, 48, 49, 96)], "h int")
    got = [r[0] for r in df.select(horizon_group("h")).collect()]
    assert got == ["H1", "H1", "H2", "H2", "H3", "H3", "H4", "H4"]


# ---- status -----------------------------------------------------------------
@pytest.mark.parametrize(
    "now, start",
    [
        (datetime(2026, 8, 20, 5), datetime(2026, 8, 12)),
        (datetime(2026, 8, 3), datetime(2026, 7, 12)),
        (datetime(2026, 1, 5), datetime(2025, 12, 12)),
        (datetime(2026, 8, 12), datetime(2026, 8, 12)),
    ],
)
def test_billing_period(now, start):
    assert status.period_start(now, 12) == start


@pytest.mark.parametrize("used, state", [(74, "ok"), (75, "warn"), (89, "warn"), (90, "over")])
def test_usage_thresholds(spark, used, state):
    ledger = spark.createDataFrame(
        [(at(0), 10**6, 1), (datetime(2024, 1, 15, tzinfo=UTC), used, 3)],
        "recorded_at_utc timestamp, bytes_estimated long, rows_returned long")
    row = status.usage_state(ledger, datetime(2024, 1, 20, tzinfo=UTC), 12, 100).first()
    assert row["state"] == state and row["runs_recorded"] == 1


def test_status_warns_when_nothing_ran(spark):
    empty = spark.createDataFrame([], "recorded_at_utc timestamp, bytes_estimated long, rows_returned long")
    runs = spark.createDataFrame([], "run_id string")
    df = spine(spark, START, START + timedelta(days=1), 1)
    row = status.status(df, runs, empty, datetime(2024, 1, 20, tzinfo=UTC)).first()
    assert row["warnings"] == ["no runs recorded"] and row["periods"] == 96


def test_scheduled_sources_leave_out_deferred_ones():
    assert [n for n, _ in status.ingest_plan(START, list(C.SOURCES))] == [
        n for n in C.SOURCES if n not in ("ci_regional", "ex_price")
    ]
    for s in C.SOURCES.values():
        assert s.time_column in s.keys


def test_failed_runs_are_logged_and_raised(spark):
    path = scratch_dir(spark, "log")

    def fails(run):
        run.rows_read = 3
        raise ValueError("x" * 5000)

    def partial(run):
        run.partial = True

    with pytest.raises(ValueError):
        runlog.run_logged(spark, path, "r", "s", "ingest", fails)
    runlog.run_logged(spark, path, "r", "s", "gapfill", partial)
    rows = {r["status"]: r for r in spark.read.schema(runlog.SCHEMA).parquet(path).collect()}
    assert set(rows) == {"failed", "partial"}
    assert rows["failed"]["error_class"] == "ValueError" and len(rows["failed"]["error_detail"]) == 2000


def test_a_failed_payload_leaves_the_previous_one(spark):
    out = scratch_dir(spark, "pay")

    def broken():
        raise ValueError("no")

    now = datetime(2024, 1, 1, tzinfo=UTC)
    payloads.publish_payloads(spark, {"a": lambda: spark.range(2)}, out, now)
    result = payloads.publish_payloads(spark, {"a": broken, "b": lambda: spark.range(1)}, out, now)
    assert result == {"a": "ValueError: no", "b": "ok"}
    assert payloads.read_payload(spark, out, "a").count() == 2
    held = payloads.current(spark, out)
    assert held["failed"] == {"a": "ValueError: no"} and set(held["files"]) == {"a", "b"}
    with pytest.raises(KeyError):
        payloads.payload_path(spark, out, "c")


@pytest.mark.parametrize("step", range(4))
def test_a_run_that_dies_at_any_step_changes_nothing_for_readers(spark, monkeypatch, step):
    out, now = scratch_dir(spark, "dies"), datetime(2024, 1, 1, tzinfo=UTC)
    build = lambda n: {"a": lambda: spark.range(n), "b": lambda: spark.range(n)}
    payloads.publish_payloads(spark, build(2), out, now)
    put, calls = payloads._put, []

    def dying(spark, path, text):
        # before or after a document, or before the pointer
        calls.append(path)
        if len(calls) == step // 2 + 1 and step % 2 == 0 or "pointers" in path:
            raise KeyboardInterrupt
        put(spark, path, text)
        if len(calls) == step // 2 + 1 and step % 2 == 1:
            raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(payloads, "_put", dying)
        with pytest.raises(KeyboardInterrupt):
            payloads.publish_payloads(spark, build(5), out, now)
    assert [payloads.read_payload(spark, out, n).count() for n in "ab"] == [2, 2]
    payloads.publish_payloads(spark, build(3), out, now)
    assert payloads.read_payload(spark, out, "a").count() == 3
    assert payloads.expire(spark, out, keep=1) >= 1
    assert payloads.read_payload(spark, out, "b").count() == 3


def test_a_payload_is_one_document_or_fails(spark, monkeypatch):
    out, now = scratch_dir(spark, "rows"), datetime(2024, 1, 1, tzinfo=UTC)
    monkeypatch.setattr(payloads, "MAX_ROWS", 3)
    result = payloads.publish_payloads(
        spark, {"few": lambda: spark.range(3), "many": lambda: spark.range(4), "none": lambda: spark.range(0)}, out, now)
    assert result["few"] == result["none"] == "ok" and "more than 3 rows" in result["many"]
    text = spark.read.text(payloads.payload_path(spark, out, "few")).collect()
    assert len(text) == 1 and '"payload":[{"id":0},{"id":1},{"id":2}]' in text[0]["value"]


def test_lineage_is_read_from_the_plan(spark):
    """Subqueries and unions are walked, and no file is listed."""
    path = scratch_dir(spark, "deep")
    spark.range(3).write.parquet(f"{path}/fct_demand_current")
    spark.range(3).write.parquet(f"{path}/clean")
    banned = spark.read.parquet(f"{path}/fct_demand_current")
    clean = spark.read.parquet(f"{path}/clean")
    names = ["fct_demand_current"]
    hidden = clean.where(F.col("id") < banned.agg(F.max("id")).scalar())
    for frame in (hidden, clean.union(banned), clean.join(banned, "id", "left_semi"), hidden.groupBy("id").count()):
        with pytest.raises(Q.LineageError):
            Q.check_lineage(frame, names)
    assert Q.check_lineage(clean, names).count() == 3
    assert any(s.endswith("/clean") for s in Q.sources_of(clean))
