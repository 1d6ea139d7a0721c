"""Every query with SQL gives what DuckDB gives on the same tables."""

import decimal
import os

import duckdb
import pandas as pd
import pytest

from tidemark.queries import ORACLE, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# At the smallest scale these have nothing to report, or too few rows to calibrate from.
MAY_BE_EMPTY = {
    "a19_error_quantiles", "f18_calibrate", "k1_newest_calibration", "f19_load_calibration",
    "s13_calibration_sink", "a22_interval_report", "n35_conformal_intervals",
    "j5_missing_unexcused", "q3_physical_range", "g2_heal_plan", "a9_conflicting_versions",
    "j7_expand_windows",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and v != v:
        return "nan"
    if hasattr(v, "isoformat"):
        stamp = pd.Timestamp(v)
        return (stamp.tz_localize(None) if stamp.tzinfo else stamp).isoformat()
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), x) for x in r])


def test_every_check_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) - len(ORACLE) <= 3


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert mine or name in MAY_BE_EMPTY, "an empty result proves nothing"
    assert ordered(mine) == ordered(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_checks_of_landing_can_fail(spark):
    """The change rule suppresses rows of the input it is checked on, and an upsert changes some."""
    from tidemark.fixtures.adapters import Tables
    from tidemark.queries.landing import halves

    t = Tables(spark, SF)
    first, second = halves(t, t.busy())
    n = QUERIES["l1_insert_if_changed"](spark, SF).count()
    assert 0 < n < 0.9 * second.count()
    assert QUERIES["t4_land_stream"](spark, SF).count() == first.count() + n
    before = t.weather_hour().agg({"wind_speed_100m_kmh": "sum"}).first()[0]
    assert QUERIES["t2_accumulate_upsert"](spark, SF).agg({"wind_speed_100m_kmh": "sum"}).first()[0] != before


@pytest.mark.parametrize("name", ["q4_matured_have_actual", "q11_x22_mart_is_current"])
def test_assertions_can_fail(spark, name):
    row = QUERIES[name](spark, SF).first()
    assert 0 < row["violations"] < row["rows_checked"] and not row["passed"]


def test_every_state_of_the_lifecycle_occurs(spark):
    states = QUERIES["t3_lifecycle"](spark, SF).select("state").distinct().collect()
    assert {r["state"] for r in states} == {"unscoreable", "matured", "pending"}
