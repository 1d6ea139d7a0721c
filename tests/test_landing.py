"""Landing keeps what changed, in order, once."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import START, UTC, at
from pyspark.sql import functions as F

from tidemark.functions.scalar import canonical_hash, instant
from tidemark.operators import versions as V
from tidemark.plans import marts
from tidemark.session import scratch_dir
from tidemark.sources import tables as S
from tidemark.streaming import buckets, land

SCHEMA = (
    "landing_id long, sp_start_utc timestamp, payload string, payload_hash string, "
    "fetched_at_utc timestamp"
)
KEYS = ["sp_start_utc"]


def rows(spark, items):
    """(landing_id, position, payload, fetched hour) to landing rows."""
    data = [(i, at(p), x, x, START + timedelta(hours=h)) for i, p, x, h in items]
    return spark.createDataFrame(data, SCHEMA)


def kept(df):
    return sorted((r["landing_id"], r["payload"]) for r in df.collect())


def test_unchanged_batch_writes_nothing(spark):
    stored = rows(spark, [(1, 0, "A", 1), (2, 1, "B", 1)])
    again = rows(spark, [(3, 0, "A", 2), (4, 1, "B", 2)])
    assert kept(V.insert_if_changed(stored, again, KEYS)) == []


def test_only_changed_rows_are_written(spark):
    stored = rows(spark, [(i, i, "x", 1) for i in range(10)])
    batch = rows(spark, [(10 + i, i, "y" if i in (3, 7) else "x", 2) for i in range(10)])
    assert kept(V.insert_if_changed(stored, batch, KEYS)) == [(13, "y"), (17, "y")]


def test_a_value_that_returns_is_written_again(spark):
    stored = rows(spark, [(1, 0, "A", 1), (2, 0, "B", 2)])
    assert kept(V.insert_if_changed(stored, rows(spark, [(3, 0, "A", 3)]), KEYS)) == [(3, "A")]


def test_repeats_inside_a_batch_stay(spark):
    stored = rows(spark, [(1, 0, "A", 1)])
    batch = rows(spark, [(2, 0, "B", 2), (3, 0, "B", 2)])
    assert len(kept(V.insert_if_changed(stored, batch, KEYS))) == 2


def test_ties_are_broken_by_landing_id(spark):
    tied = rows(spark, [(1, 0, "A", 1), (2, 0, "B", 1)])
    assert V.latest_row(tied, KEYS).first()["payload"] == "B"
    assert kept(V.insert_if_changed(tied, rows(spark, [(3, 0, "B", 2)]), KEYS)) == []


@pytest.mark.parametrize(
    "a, b, same",
    [
        ('{"a":1,"b":2}', '{ "b": 2, "a": 1 }', True),
        ('{"a":{"x":1,"y":[1,2]}}', '{"a":{"y":[1,2],"x":1}}', True),
        ('{"a":200}', '{"a":201}', False),
        ('{"a":null}', '{"a":137}', False),
        ('{"a":null}', "{}", False),
    ],
)
def test_canonical_hash(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(canonical_hash("a").alias("a"), canonical_hash("b").alias("b")).first()
    assert (row["a"] == row["b"]) is same


def test_scd2_intervals(spark):
    df = rows(spark, [(1, 0, "A", 1), (2, 0, "A", 2), (3, 0, "B", 30), (4, 0, "A", 55), (5, 1, "Z", 9)])
    got = [
        (r["payload"], r["valid_from"].hour, r["valid_to"] is None)
        for r in V.scd2(df, KEYS, ["payload"]).orderBy("sp_start_utc", "valid_from").collect()
    ]
    assert got == [("A", 1, False), ("B", 6, False), ("A", 7, True), ("Z", 9, True)]


def test_scd2_in_two_steps_equals_one(spark):
    items = [(i, i % 3, "AB"[(i // 5) % 2], i) for i in range(60)]
    whole = V.scd2(rows(spark, items), KEYS, ["payload"])
    first = V.scd2(rows(spark, items[:33]), KEYS, ["payload"])
    both = V.scd2_apply(first, rows(spark, items[33:]), KEYS, ["payload"])
    assert sorted(whole.collect()) == sorted(both.collect()) and whole.count() > 6


@pytest.mark.parametrize("seed", range(3))
def test_scd2_is_what_a_plain_walk_finds(spark, seed):
    """Runs over many chunks, chunks without a change, ties in time and nulls."""
    rng = random.Random(seed)
    data = []
    for i in range(400):
        held = rng.choice(["A", "A", "A", "B", None])
        data.append((i, at(rng.randrange(3)), held, "h", START + timedelta(hours=rng.choice([0, 1, 1, 2, 9, 30]) + i // 4)))
    want = []
    for key in {d[1] for d in data}:
        last, runs = object(), []
        for i, _, held, _, when in sorted((d for d in data if d[1] == key), key=lambda d: (d[4], d[0])):
            if held != last:
                runs.append((key, held, when, i))
            last = held
        want += [(*r[:3], n[2] if n else None, r[3]) for r, n in zip(runs, [*runs[1:], None])]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    for chunk in (3600, 6 * 3600, 10**7):
        got = [
            tuple(x.replace(tzinfo=UTC) if isinstance(x, datetime) else x for x in r)
            for r in V.scd2(df, KEYS, ["payload"], chunk).collect()
        ]
        assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 60


def test_scd2_treats_null_as_a_value(spark):
    data = [(1, at(0), None, "h", at(0)), (2, at(0), None, "h", at(2)), (3, at(0), "x", "h", at(4))]
    df = spark.createDataFrame(data, SCHEMA)
    assert V.scd2(df, KEYS, ["payload"]).count() == 2


def test_conflicting_versions_come_one_a_row(spark):
    df = rows(spark, [(i, 0, str(i), i // 4) for i in range(25)] + [(99, 1, "one", 1)])
    got = V.conflicting_versions(df, KEYS, ["payload"]).orderBy("position").collect()
    assert [(r["position"], r["landing_id"], r["payload"]) for r in got] == [
        (i + 1, i, str(i)) for i in range(25)
    ]
    assert {(r["versions"], r["distinct_fetch_times"]) for r in got} == {(25, 7)}


def test_stream_keeps_a_value_that_returns(spark):
    """A, B, B, A in four files gives A, B, A; a drained stream adds nothing more."""
    src, out, mark = (scratch_dir(spark, n) for n in ("src", "out", "mark"))
    for i, x in enumerate("ABBA"):
        rows(spark, [(i, 0, x, i)]).coalesce(1).write.mode("append").json(f"{src}")
        stream = spark.readStream.schema(SCHEMA).json(src)
        land.land_stream(spark, stream, out, mark, KEYS)
    got = land.read_landing(spark, out).orderBy("landing_id").collect()
    assert [r["payload"] for r in got] == ["A", "B", "A"]
    land.land_stream(spark, spark.readStream.schema(SCHEMA).json(src), out, mark, KEYS)
    assert land.read_landing(spark, out).count() == 3


def test_replayed_batch_rewrites_the_same_rows(spark):
    out = scratch_dir(spark, "replay")
    land.land_batch(spark, out, rows(spark, [(1, 0, "A", 1)]), KEYS, 0)
    for _ in range(2):
        land.land_batch(spark, out, rows(spark, [(2, 0, "B", 2), (3, 1, "C", 2)]), KEYS, 1)
    assert kept(land.read_landing(spark, out)) == [(1, "A"), (2, "B"), (3, "C")]


def test_ids_continue_after_the_stored_maximum(spark):
    stored = rows(spark, [(7, 0, "A", 1)])
    batch = rows(spark, [(0, 2, "C", 3), (0, 1, "B", 2)]).drop("landing_id")
    got = V.with_landing_ids(batch, V.last_landing_id(stored), KEYS).orderBy("landing_id").collect()
    assert [(r["landing_id"], r["payload"]) for r in got] == [(8, "B"), (9, "C")]


# ---- stored tables ----------------------------------------------------------
def test_upsert_twice_changes_nothing(spark):
    path = scratch_dir(spark, "up")
    df = rows(spark, [(i, i * 20, f"v{i}", 1) for i in range(20)]).withColumn(
        "day", F.to_date("sp_start_utc")
    )
    for _ in range(2):
        S.upsert(spark, path, df, KEYS, "day")
    assert spark.read.parquet(path).count() == 20
    newer = df.where(F.col("landing_id") >= 15).withColumn("payload", F.lit("new"))
    S.upsert(spark, path, newer, KEYS, "day")
    got = spark.read.parquet(path)
    assert got.count() == 20 and got.where("payload = 'new'").count() == 5


def test_append_ignores_what_is_stored(spark):
    path = scratch_dir(spark, "app")
    df = rows(spark, [(1, 0, "A", 1), (2, 1, "B", 1), (2, 1, "B", 1)])
    S.append_new(spark, df, path, ["landing_id"])
    S.append_new(spark, df, path, ["landing_id"])
    assert spark.read.parquet(path).count() == 2


def test_lookback_counts_from_now_when_the_target_reaches_ahead(spark):
    target = rows(spark, [(1, 48 * 100, "A", 1)])
    as_of = at(48 * 50)
    got = spark.range(1).select(marts.incremental_since(target, instant(as_of))).first()[0]
    assert got.replace(tzinfo=UTC) == as_of - timedelta(days=14)


def test_prune_refuses_without_its_mart(spark):
    df = rows(spark, [(1, 0, "A", 1), (2, 48 * 20, "B", 1)])
    now = instant(datetime(2024, 1, 22, tzinfo=UTC))
    with pytest.raises(ValueError, match="empty"):
        V.prune(df, "sp_start_utc", 7, now, df.limit(0))
    assert kept(V.prune(df, "sp_start_utc", 7, now, df)) == [(2, "B")]


def test_summary_with_missing_rows_is_refused(spark):
    with pytest.raises(ValueError, match="expected 16"):
        S.append_counted(spark.range(15), scratch_dir(spark, "cal"), 16)


# ---- streams ----------------------------------------------------------------
def drained(spark, stream, mode, name):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", scratch_dir(spark, name))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)


def test_buckets_and_sessions_stream_like_the_batch(spark):
    """Closed windows appear once the watermark passes them."""
    src = scratch_dir(spark, "events")
    rows(spark, [(i, p, "x", 1) for i, p in enumerate([0, 1, 2, 10, 11, 400])]).write.json(src)
    stream = spark.readStream.schema(SCHEMA).json(src)
    count = [F.count(F.lit(1)).alias("n")]
    live = drained(spark, buckets.bucket(stream, count, "sp_start_utc", width="1 hour", late="1 hour"),
                   "append", "hours")
    batch = buckets.bucket(spark.read.schema(SCHEMA).json(src), count, "sp_start_utc", width="1 hour")
    closed = batch.where(F.col("sp_start_utc") < F.lit(at(300)))
    assert sorted(live.collect()) == sorted(closed.collect()) and live.count() == 3
    # A streaming session needs a key besides its window.
    keyed = stream.withColumn("k", F.lit("a"))
    out = drained(spark, buckets.sessions(keyed, keys=["k"], late="1 hour"), "append", "outages")
    got = sorted((r["periods"], r["window_to_utc"].replace(tzinfo=UTC)) for r in out.collect())
    assert got == [(2, at(12)), (3, at(3))]


def test_compaction_survives_a_failure_at_any_step(spark, monkeypatch):
    out = scratch_dir(spark, "compacted")
    for i, (day, p) in enumerate([(0, "A"), (1, "B"), (2, "C")]):
        land.land_batch(spark, out, rows(spark, [(i, 48 * day, p, i)]), KEYS, i)
    before = kept(land.read_landing(spark, out))

    def fails(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # rows written, zones not
        m.setattr(land, "_zone", fails)
        with pytest.raises(RuntimeError):
            land.compact(spark, out)
    assert kept(land.read_landing(spark, out)) == before
    with monkeypatch.context() as m:  # zones written, nothing deleted
        calls = []
        m.setattr(land, "_delete", lambda s, f: calls.append(f) if not calls else fails())
        with pytest.raises(RuntimeError):
            land.compact(spark, out)
    assert kept(land.read_landing(spark, out)) == before
    land.land_batch(spark, out, rows(spark, [(9, 0, "D", 9)]), KEYS, land.next_batch_id(spark, out))
    assert land.compact(spark, out) == 2
    assert kept(land.read_landing(spark, out)) == sorted([*before, (9, "D")])
    assert len(land._batch_ids(spark, out)) == 1


def test_a_batch_without_zones_is_read_whole(spark):
    out = scratch_dir(spark, "zoneless")
    land.land_batch(spark, out, rows(spark, [(1, 0, "A", 1)]), KEYS, 0)
    land.land_batch(spark, out, rows(spark, [(2, 48, "B", 2)]), KEYS, 1)
    land._delete(spark, [f"{out}/_zones/zone-0"])
    assert kept(land.read_landing(spark, out)) == [(1, "A"), (2, "B")]
    assert land.compact(spark, out) == 2 and kept(land.read_landing(spark, out)) == [(1, "A"), (2, "B")]


# ---- retention by folder --------------------------------------------------------
def days_landed(spark, path, batches=2):
    """Ten days of two periods in each batch; the second batch changes every value."""
    for b in range(batches):
        items = [(b * 100 + i, i * 24, f"{b}-{i}", b + 1) for i in range(20)]
        land.land_batch(spark, path, rows(spark, items), KEYS, b)
    return land.read_landing(spark, path)


def test_old_days_go_whole_and_are_listed(spark):
    path = scratch_dir(spark, "retain")
    df = days_landed(spark, path)
    cutoff, now = instant(START + timedelta(days=4, hours=6)), instant(START + timedelta(days=9))
    went = land.prune_days(spark, path, cutoff, now, df, KEYS)
    # day 4 has a period after the cutoff, so all of it stays
    assert sorted((r["batch_id"], r["rows"]) for r in went.collect()) == [(0, 2)] * 4 + [(1, 2)] * 4
    left = land.read_landing(spark, path)
    assert left.count() == 24 and left.agg(F.min("sp_start_utc")).first()[0] == at(8 * 24).replace(tzinfo=None)
    assert not S.exists(spark, f"{path}/batch_id=0/day={START.date()}")
    assert land.prune_days(spark, path, cutoff, instant(START + timedelta(days=9, hours=1)), df, KEYS).count() == 0


def test_nothing_goes_unless_the_mart_holds_it_all(spark):
    path = scratch_dir(spark, "refuse")
    df = days_landed(spark, path, 1)
    cutoff = now = instant(START + timedelta(days=5))
    with pytest.raises(land.RetentionError, match="lacks 1 "):
        land.prune_days(spark, path, cutoff, now, df.where(F.col("landing_id") != 3), KEYS)
    assert land.read_landing(spark, path).count() == 20 and land.pruned(spark, path).count() == 0


def test_a_prune_that_dies_before_deleting_is_heeded_and_finished(spark, monkeypatch):
    path = scratch_dir(spark, "died")
    df = days_landed(spark, path)
    cutoff = now = instant(START + timedelta(days=5))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(land, "_delete", dies)
        with pytest.raises(OSError):
            land.prune_days(spark, path, cutoff, now, df, KEYS)
    first = f"{path}/batch_id=0/day={START.date()}"
    assert S.exists(spark, first) and land.read_landing(spark, path).count() == 20
    assert land.compact(spark, path) == 2  # drops what the failure left
    assert not S.exists(spark, first) and land.read_landing(spark, path).count() == 20


def test_a_period_that_went_may_land_again(spark):
    path = scratch_dir(spark, "again")
    df = days_landed(spark, path)
    cutoff = now = instant(START + timedelta(days=5))
    land.prune_days(spark, path, cutoff, now, df, KEYS)
    land.land_batch(spark, path, rows(spark, [(900, 0, "1-0", 9)]), KEYS, 2)
    assert kept(land.read_landing(spark, path).where("landing_id = 900")) == [(900, "1-0")]
