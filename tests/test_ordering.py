"""Chunked windows against plain Python, with chunks small enough to be crossed often."""

import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import HALF, START, UTC, at
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import asof
from tidemark.operators import ordering as O
from tidemark.operators.percentiles import exact_percentiles
from tidemark.plans import marts
from tidemark.sources.spine import spine, spine_of
from tidemark.sources.windows import request_windows
from tidemark.streaming import buckets

KEYS = ["series_key"]


def sparse(spark, seed=3, keys=("a", "b"), periods=400, share=0.6):
    """Series with holes; returns the frame and {key: [(position, value)]}."""
    rng = random.Random(seed)
    plain = {
        k: [(p, rng.randint(0, 999)) for p in range(periods) if rng.random() < share] for k in keys
    }
    rows = [(k, at(p), float(v)) for k, items in plain.items() for p, v in items]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "series_key string, sp_start_utc timestamp, actual double"), plain


def by_row(df, col):
    return {
        (r["series_key"], r["sp_start_utc"].replace(tzinfo=UTC)): r[col] for r in df.collect()
    }


@pytest.mark.parametrize("chunk", [1800, 5 * 3600, 10**9])
def test_ordinal(spark, chunk):
    df, plain = sparse(spark)
    got = by_row(O.ordinal(df, KEYS, chunk_seconds=chunk), "pos")
    want = {(k, at(p)): i for k, items in plain.items() for i, (p, _) in enumerate(items, 1)}
    assert got == want


@pytest.mark.parametrize("chunk", [3600, 7 * 3600])
def test_neighbours(spark, chunk):
    df, plain = sparse(spark)
    prev = by_row(O.previous_row(df, KEYS, ["actual"], chunk_seconds=chunk), "prev")
    nxt = by_row(O.next_row(df, KEYS, ["actual"], chunk_seconds=chunk), "next")
    for k, items in plain.items():
        for i, (p, _) in enumerate(items):
            before = prev[(k, at(p))]
            after = nxt[(k, at(p))]
            assert (before and before["actual"]) == (items[i - 1][1] if i else None)
            assert (after and after["actual"]) == (
                items[i + 1][1] if i + 1 < len(items) else None
            )


def test_running_sum(spark):
    df, plain = sparse(spark)
    got = by_row(O.running_sum(df, KEYS, {"s": F.col("actual")}, chunk_seconds=3600), "s")
    for k, items in plain.items():
        for i, (p, _) in enumerate(items):
            assert got[(k, at(p))] == sum(v for _, v in items[: i + 1])


def test_national_series_without_keys(spark):
    df, plain = sparse(spark, keys=("a",))
    got = O.ordinal(df, [], chunk_seconds=3600).agg(F.max("pos")).first()[0]
    assert got == len(plain["a"])


def test_lag_counts_rows_not_hours(spark):
    df, plain = sparse(spark)
    got = by_row(O.lag_rows(df, KEYS, "actual", 48), "lagged")
    for k, items in plain.items():
        for i, (p, _) in enumerate(items):
            assert got[(k, at(p))] == (items[i - 48][1] if i >= 48 else None)


def test_scales_differ_where_rows_are_missing(spark):
    df, plain = sparse(spark, keys=("a",))
    items = plain["a"]
    positional = np.mean([abs(items[i][1] - items[i - 48][1]) for i in range(48, len(items))])
    held = dict(items)
    timed = np.mean([abs(v - held[p - 48]) for p, v in items if p - 48 in held])
    assert O.naive_scale_positional(df, KEYS).first()["scale"] == pytest.approx(positional)
    as_of = F.lit(at(400)).cast("timestamp")
    assert O.naive_scale_time(df, KEYS, as_of).first()["scale"] == pytest.approx(timed)
    assert positional != pytest.approx(timed)


def test_rolling_frames_cross_chunks(spark):
    df, plain = sparse(spark)
    got = by_row(O.rolling_stats(df, KEYS, "actual", 5), "mean_5h")
    std = by_row(O.rolling_stats(df, KEYS, "actual", 5), "std_5h")
    for k, items in plain.items():
        for p, _ in items:
            window = [v for q, v in items if p - 10 < q <= p]
            assert got[(k, at(p))] == pytest.approx(np.mean(window))
            s = std[(k, at(p))]
            assert s is None if len(window) < 2 else s == pytest.approx(np.std(window, ddof=1))


def test_trailing_rows_count_rows(spark):
    df, plain = sparse(spark)
    anchors = spark.createDataFrame(
        [(k, at(p)) for k in "ab" for p in (3, 200, 399, 5000)],
        "series_key string, origin_utc timestamp",
    )
    rows = asof.trailing_rows_mean(df, anchors, ["actual"], KEYS).collect()
    assert len(rows) == 8
    for r in rows:
        p0 = (r["origin_utc"].replace(tzinfo=UTC) - START) / HALF
        tail = [v for p, v in plain[r["series_key"]] if p <= p0][-48:]
        assert r["trailing_actual"] == pytest.approx(np.mean(tail))


# ---- gaps -------------------------------------------------------------------
def periods(spark, offsets):
    return spark.createDataFrame([(at(o),) for o in offsets], "sp_start_utc timestamp")


@pytest.mark.parametrize(
    "offsets, want",
    [
        ([0, 1, 2, 3], [(0, 4)]),
        ([0, 1, 10, 11], [(0, 2), (10, 12)]),
        ([5], [(5, 6)]),
        ([], []),
        (list(range(100, 4000)), [(100, 4000)]),
    ],
)
def test_windows_end_exclusive(spark, offsets, want):
    df = periods(spark, offsets)
    got = sorted(
        (r["window_from_utc"].replace(tzinfo=UTC), r["window_to_utc"].replace(tzinfo=UTC))
        for r in O.coalesce_periods(df).collect()
    )
    assert got == [(at(a), at(b)) for a, b in want]
    gaps = sorted(
        (r["gap_start_utc"].replace(tzinfo=UTC), r["gap_end_utc"].replace(tzinfo=UTC))
        for r in O.islands(df).collect()
    )
    assert gaps == [(at(a), at(b - 1)) for a, b in want]
    if offsets:
        sessions = buckets.sessions(df).count()
        assert sessions == len(want)


# ---- spine and windows ------------------------------------------------------
def test_spine_extent(spark):
    df = spine(spark, START, START + timedelta(days=10, hours=7), forward_days=60)
    rows = df.agg(F.count("*"), F.max("sp_start_utc")).first()
    assert rows[0] == 70 * 48
    assert rows[1].replace(tzinfo=UTC) == START + timedelta(days=70) - HALF


def test_spine_of_a_table_covers_whole_days(spark):
    df = spine_of(periods(spark, [5, 100]))
    assert df.count() == 3 * 48


def test_clock_change_days(spark):
    from datetime import datetime

    year = spine(spark, datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 12, 31, tzinfo=UTC), 1)
    counts = (
        marts.dim_settlement_period(year)
        .groupBy("periods_in_local_day")
        .agg(F.countDistinct("settlement_date_local").alias("n"))
    )
    assert {r[0]: r[1] for r in counts.collect()} == {46: 1, 48: 364, 50: 1}


@pytest.mark.parametrize("days, span, want", [(365, 28, 14), (152, 28, 6), (28, 28, 1), (0, 28, 0)])
def test_request_windows(spark, days, span, want):
    df = spark.createDataFrame(
        [(START, START + timedelta(days=days))],
        "window_from_utc timestamp, window_to_utc timestamp",
    )
    rows = request_windows(df, span * 86400).orderBy("chunk_from_utc").collect()
    assert len(rows) == want
    for a, b in zip(rows, rows[1:]):
        assert a["chunk_to_utc"] == b["chunk_from_utc"]
    if rows:
        assert rows[-1]["chunk_to_utc"].replace(tzinfo=UTC) == START + timedelta(days=days)


def test_windows_of_backward_feeds_end_now(spark):
    df = spark.createDataFrame(
        [(START, START + timedelta(days=5)), (START + timedelta(days=4), START + timedelta(days=5))],
        "window_from_utc timestamp, window_to_utc timestamp",
    )
    now = F.lit(START + timedelta(days=2)).cast("timestamp")
    rows = request_windows(df, 86400, clamp_to=now).collect()
    assert len(rows) == 2


def test_origin_grid_ends(spark):
    assert C.Grid(START, START + timedelta(days=3), 24, True).count == 4
    assert C.Grid(START, START + timedelta(days=3), 24, False).count == 3
    assert C.Grid(START, START + timedelta(hours=30), 24, False).count == 2
    assert C.Grid.single(START).count == 1


def test_origins_are_found_by_arithmetic(spark):
    """The generator agrees with comparing every row with every issue time."""
    grid = C.Grid(at(100), at(300), 12)
    df = periods(spark, range(0, 500, 7))
    got = {
        (r[0].replace(tzinfo=UTC), r[1].replace(tzinfo=UTC))
        for r in O.explode_origins(df, grid, "sp_start_utc", -3600, 96 * 1800).collect()
    }
    issued = [grid.start + timedelta(hours=12 * k) for k in range(grid.count)]
    want = {
        (at(p), o)
        for p in range(0, 500, 7)
        for o in issued
        if -timedelta(hours=1) <= at(p) - o <= timedelta(hours=48)
    }
    assert got == want and len(got) > 50


# ---- percentiles ------------------------------------------------------------
@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_percentiles(spark, accuracy):
    """With a coarse sketch the brackets are used; the answer stays exact."""
    rng = np.random.default_rng(5)
    groups = {
        "hot": rng.lognormal(size=20_000).round(3),
        "ties": rng.integers(0, 3, 3_000).astype(float),
        "tiny": np.array([4.0, 1.0, 9.0]),
        "one": np.array([7.0]),
    }
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("tiny", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    levels = {"a": 0.0, "b": 0.025, "c": 0.1, "d": 0.5, "e": 0.9, "f": 0.975, "g": 1.0}
    for r in exact_percentiles(df, ["k"], "x", levels, accuracy).collect():
        for n, level in levels.items():
            assert r[n] == pytest.approx(np.quantile(groups[r["k"]], level), abs=1e-9), (r["k"], n)
    whole = np.concatenate(list(groups.values()))
    row = exact_percentiles(df, [], "x", levels, accuracy).first()
    for n, level in levels.items():
        assert row[n] == pytest.approx(np.quantile(whole, level), abs=1e-9)
