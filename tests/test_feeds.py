"""Captured responses become landing rows, and landing rows become typed views."""

import json

import pytest
from conftest import UTC, at
from pyspark.sql import functions as F

from tidemark.operators.audits import band_drift, band_ranges, conflicts, banded
from tidemark.plans import staging
from tidemark.plans.marts import dim_region, mix_wide
from tidemark.session import scratch_dir
from tidemark.sources import feeds


def captured(tmp_path, *docs):
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    return str(tmp_path)


def with_ids(df):
    return df.withColumn("landing_id", F.monotonically_increasing_id())


def test_intensity(spark, tmp_path):
    path = captured(tmp_path, {"data": [
        {"from": "2024-01-01T00:00Z", "to": "2024-01-01T00:30Z",
         "intensity": {"forecast": 120, "actual": "117", "index": "moderate"}},
        {"from": "2024-01-01T00:30Z", "to": "2024-01-01T01:00Z",
         "intensity": {"forecast": 121, "actual": None, "index": "low"}},
    ]})
    rows = feeds.read_intensity(spark, path, whole=True)
    assert rows.count() == 2
    got = staging.stg_intensity(with_ids(rows)).orderBy("sp_start_utc").collect()
    assert [(r["actual"], r["benchmark"]) for r in got] == [(117, 120), (None, 121)]
    assert got[0]["sp_start_utc"].replace(tzinfo=UTC) == at(0)
    assert "index" not in got[0].asDict()


def test_payload_is_canonical(spark, tmp_path):
    a = {"from": "2024-01-01T00:00Z", "intensity": {"forecast": 1, "actual": None}}
    b = {"intensity": {"actual": None, "forecast": 1}, "from": "2024-01-01T00:00Z"}
    rows = feeds.read_intensity(spark, captured(tmp_path, {"data": [a]}, {"data": [b]}), True).collect()
    assert len({r["payload_hash"] for r in rows}) == 1
    assert '"actual":null' in rows[0]["payload"]


def test_genmix(spark, tmp_path):
    mix = [{"fuel": "wind", "perc": 40.1}, {"fuel": "gas", "perc": 59.9}, {"fuel": "coal", "perc": 0}]
    path = captured(tmp_path, {"data": [{"from": "2024-01-01T00:00Z", "generationmix": mix}]})
    rows = staging.stg_genmix(with_ids(feeds.read_genmix(spark, path, True)))
    assert {(r["fuel"], float(r["perc"]), r["is_low_carbon"], r["is_fossil"]) for r in rows.collect()} == {
        ("wind", 40.1, True, False), ("gas", 59.9, False, True), ("coal", 0.0, False, True)
    }
    wide = mix_wide(rows).first()
    assert float(wide["total_perc"]) == 100.0 and wide["imports_perc"] is None


def test_regional_has_no_actual(spark, tmp_path):
    regions = [{"regionid": i, "shortname": f"R{i}", "dnoregion": "D", "intensity": {"forecast": i}}
               for i in (1, 2)]
    path = captured(tmp_path, {"data": [{"from": "2024-01-01T00:00Z", "regions": regions}]})
    rows = staging.stg_regional(with_ids(feeds.read_regional(spark, path, True)))
    assert rows.count() == 2 and "actual" not in rows.columns
    assert rows.where("is_scoreable").isEmpty()
    assert dim_region(rows).count() == 2


def test_region_ids_beyond_a_short(spark, tmp_path):
    region = {"regionid": 40235, "shortname": "R", "dnoregion": "D", "intensity": {"forecast": 1}}
    path = captured(tmp_path, {"data": [{"from": "2024-01-01T00:00Z", "regions": [region]}]})
    rows = staging.stg_regional(with_ids(feeds.read_regional(spark, path, True)))
    assert [r["region_id"] for r in rows.collect()] == [40235]


def test_demand_keeps_every_vintage(spark, tmp_path):
    base = {"startTime": "2024-01-01T00:00:00Z", "settlementDate": "2024-01-01",
            "settlementPeriod": 1, "initialDemandOutturn": "20001",
            "initialTransmissionSystemDemandOutturn": 21000}
    docs = {"data": [dict(base, publishTime=f"2024-01-01T0{h}:30:00Z") for h in (0, 1)]}
    rows = staging.stg_demand(with_ids(feeds.read_demand(spark, captured(tmp_path, docs), True)))
    assert rows.count() == 2
    assert {(r["demand_indo_mw"], r["settlement_period_no"]) for r in rows.collect()} == {(20001, 1)}


def test_price_flags_zero_volume(spark, tmp_path):
    docs = {"data": [
        {"startTime": "2024-01-01T00:00:00Z", "dataProvider": "A", "price": 0, "volume": 0},
        {"startTime": "2024-01-01T00:00:00Z", "dataProvider": "B", "price": 51.25, "volume": 10.5},
    ]}
    rows = staging.stg_price(with_ids(feeds.read_price(spark, captured(tmp_path, docs), True)))
    assert {(r["data_provider"], r["is_zero_volume"]) for r in rows.collect()} == {("A", True), ("B", False)}


@pytest.mark.parametrize("bare", [True, False])
def test_weather_positions_and_empty_hours(spark, tmp_path, bare):
    block = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"],
                        "temperature_2m": [1.5, None], "wind_speed_100m": [9, None],
                        "shortwave_radiation": [None, None], "cloud_cover": [100, None]}}
    docs = block if bare else [block, block, block]
    rows = feeds.read_weather(spark, captured(tmp_path, docs), ["x", "y"], whole=True)
    got = staging.stg_weather(with_ids(rows)).collect()
    assert sorted(r["location_id"] for r in got) == (["x"] if bare else ["x", "y"])
    assert float(got[0]["temperature_2m_c"]) == 1.5 and got[0]["shortwave_radiation_wm2"] is None


def test_weather_sums_beyond_four_digits(spark, tmp_path):
    block = {"hourly": {"time": ["2024-01-01T00:00"], "temperature_2m": [1.5], "wind_speed_100m": [10752.78],
                        "shortwave_radiation": [None], "cloud_cover": [None]}}
    row = staging.stg_weather(with_ids(feeds.read_weather(spark, captured(tmp_path, block), ["x"], whole=True))).first()
    assert str(row["wind_speed_100m_kmh"]) == "10752.78"


def test_seed_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "window_from_utc,window_to_utc,periods,source,reason,verified_on\n"
        '2024-01-01T17:00:00Z,2024-01-01T17:30:00Z,1,hh,"gone, for good",2024-02-01\n'
    )
    row = feeds.read_seed(spark, str(tmp_path)).first()
    assert row["periods"] == 1 and row["reason"] == "gone, for good"
    assert row["window_from_utc"].replace(tzinfo=UTC) == at(34)


def test_band_audits_and_conflicts(spark):
    data = [
        (i, at(i), json.dumps({"intensity": {"actual": v, "forecast": v, "index": b}}), str(v), at(99))
        for i, (v, b) in enumerate([(10, "low"), (20, "moderate"), (30, "high"), (15, "low")])
    ] + [(9, at(0), json.dumps({"intensity": {"actual": 11, "forecast": 1, "index": "low"}}), "x", at(99))]
    landing = spark.createDataFrame(
        data, "landing_id long, sp_start_utc timestamp, payload string, payload_hash string, "
        "fetched_at_utc timestamp")
    rows = banded(landing, ["sp_start_utc"])
    low = {r["band"]: (r["min_actual"], r["max_actual"]) for r in band_ranges(rows).collect()}
    assert low == {"low": (11, 15), "moderate": (20, 20), "high": (30, 30)}
    assert band_drift(rows).first()["lowest_high"] == 30
    clash = sorted(conflicts(landing).collect(), key=lambda r: r["position"])
    assert [r["actual"] for r in clash] == ["10", "11"] and [r["versions"] for r in clash] == [2, 2]
    assert all(r["ordering_is_ambiguous"] for r in clash)


def test_lines_and_files_read_alike(spark, tmp_path):
    doc = {"data": [{"from": "2024-01-01T00:00Z", "intensity": {"forecast": 1, "actual": 2}}]}
    lines = scratch_dir(spark, "lines")
    spark.createDataFrame([(json.dumps(doc),)], "value string").write.text(lines)
    a = feeds.read_intensity(spark, lines).drop("fetched_at_utc").collect()
    b = feeds.read_intensity(spark, captured(tmp_path, doc), True).drop("fetched_at_utc").collect()
    assert a == b and len(a) == 1
