"""Landing, versions, retention and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.fixtures.adapters import Tables
from tidemark.functions.scalar import canonical_hash
from tidemark.operators import versions as V
from tidemark.plans import marts
from tidemark.queries.common import AS_OF, query
from tidemark.session import scratch_dir
from tidemark.sources import tables as S
from tidemark.streaming import land

LAND_KEYS = ["series_key", "sp_start_utc"]
_HALF_ID = "(SELECT (max(landing_id) + 1) // 2 FROM landing)"


def halves(t: Tables, rows=None):
    """Landing replayed in two parts by id."""
    rows = t.landing() if rows is None else rows
    cut = rows.agg(F.floor((F.max("landing_id") + 1) / F.lit(2))).scalar()
    return rows.where(F.col("landing_id") < cut), rows.where(F.col("landing_id") >= cut)


# Rows of the second half that differ from what the first half held last.
_CHANGED = f"""SELECT b.series_key, b.sp_start_utc, b.landing_id, b.payload_hash
    FROM busy b WHERE b.landing_id >= {_HALF_ID.replace("landing)", "busy)")} AND NOT EXISTS (
      SELECT 1 FROM (SELECT series_key, sp_start_utc, payload_hash FROM busy
        WHERE landing_id < {_HALF_ID.replace("landing)", "busy)")}
        QUALIFY row_number() OVER (PARTITION BY series_key, sp_start_utc
          ORDER BY fetched_at_utc DESC, landing_id DESC) = 1) l
      WHERE l.series_key = b.series_key AND l.sp_start_utc = b.sp_start_utc
        AND l.payload_hash = b.payload_hash)"""


@query("l1_insert_if_changed", "busy", _CHANGED)
def l1(t):
    """About a third of the second half repeats what its key held last."""
    first, second = halves(t, t.busy())
    return V.insert_if_changed(first, second, LAND_KEYS).select(
        *LAND_KEYS, "landing_id", "payload_hash"
    )


@query(
    "l2_canonical_hash",
    "",
    """SELECT event_id, sha256('{"a":null,"k":' || CAST(json_extract(props, '$.k') AS VARCHAR)
    || '}') AS hash FROM events""",
)
def l2(t):
    padded = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": null}'))
    return t.events().select("event_id", canonical_hash(padded).alias("hash"))


@query(
    "l3_latest_row",
    "landing",
    """SELECT series_key, sp_start_utc, landing_id, payload, fetched_at_utc FROM landing
    QUALIFY row_number() OVER (PARTITION BY series_key, sp_start_utc
      ORDER BY fetched_at_utc DESC, landing_id DESC) = 1""",
)
def l3(t):
    return V.latest_row(t.landing(), LAND_KEYS).select(
        *LAND_KEYS, "landing_id", "payload", "fetched_at_utc"
    )


@query(
    "l4_landing_history",
    "landing",
    """SELECT series_key, sp_start_utc, count(*) AS revision_count,
    min(fetched_at_utc) AS first_seen_at_utc,
    count(DISTINCT payload_hash) AS distinct_payloads FROM landing GROUP BY 1, 2""",
)
def l4(t):
    return V.landing_history(t.landing(), LAND_KEYS)


@query(
    "l5_demand_current",
    "vintage",
    """SELECT sp_start_utc, user_id, publish_time_utc, demand_mw FROM vintage
    QUALIFY row_number() OVER (PARTITION BY sp_start_utc
      ORDER BY publish_time_utc DESC, landing_id DESC) = 1""",
)
def l5(t):
    return V.demand_current(t.vintage()).select(
        "sp_start_utc", "user_id", "publish_time_utc", "demand_mw"
    )


@query(
    "l6_current_benchmark",
    "landing",
    """SELECT series_key, sp_start_utc, CAST(json_extract_string(payload, '$.k') AS INTEGER)
      AS benchmark, landing_id
    FROM landing WHERE sp_start_utc > TIMESTAMP '2024-01-15'
      AND json_extract_string(payload, '$.k') IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY series_key, sp_start_utc
      ORDER BY fetched_at_utc DESC, landing_id DESC) = 1""",
)
def l6(t):
    rows = t.landing().withColumn("benchmark", F.get_json_object("payload", "$.k").cast("int"))
    anchor = F.lit("2024-01-15").cast("timestamp")
    return V.current_benchmark(rows, LAND_KEYS, "benchmark", anchor).select(
        *LAND_KEYS, "benchmark", "landing_id"
    )


_SCD2 = """SELECT series_key, sp_start_utc, payload, fetched_at_utc AS valid_from,
    lead(fetched_at_utc) OVER (PARTITION BY series_key, sp_start_utc
      ORDER BY fetched_at_utc, landing_id) AS valid_to, landing_id
    FROM (SELECT *, lag(payload) OVER (PARTITION BY series_key, sp_start_utc
            ORDER BY fetched_at_utc, landing_id) AS was FROM landing)
    WHERE was IS DISTINCT FROM payload"""


@query("l7_scd2_snapshot", "landing", _SCD2)
def l7(t):
    return V.scd2(t.landing(), LAND_KEYS, ["payload"])


@query("l7_scd2_incremental", "busy", _SCD2.replace("FROM landing", "FROM busy"))
def l7_incremental(t):
    """Every key is open when the second half comes."""
    first, second = halves(t, t.busy())
    return V.scd2_apply(V.scd2(first, LAND_KEYS, ["payload"]), second, LAND_KEYS, ["payload"])


@query(
    "l8_prune",
    "landing",
    f"""SELECT landing_id, sp_start_utc FROM landing
    WHERE sp_start_utc >= {AS_OF} - INTERVAL '7 days'""",
)
def l8(t):
    return V.prune(t.landing(), "sp_start_utc", 7, t.as_of, t.panel()).select(
        "landing_id", "sp_start_utc"
    )


def landed(t, name: str) -> str:
    """A fresh landing folder that holds all landing rows as one batch."""
    path = scratch_dir(t.spark, name)
    land.land_batch(t.spark, path, t.landing(), LAND_KEYS, 0)
    return path


# A day goes whole or not at all.
_OLD_DAY = f"""max(sp_start_utc) OVER (PARTITION BY CAST(sp_start_utc AS DATE))
    < {AS_OF} - INTERVAL '7 days 9 hours'"""


@query(
    "l8_pruned_folder",
    "landing",
    f"SELECT landing_id, sp_start_utc FROM landing QUALIFY NOT ({_OLD_DAY})",
)
def l8_folder(t):
    """What a reader finds after the old days were dropped from the folder."""
    path = landed(t, "retained")
    cutoff = t.as_of - F.expr("interval 7 days 9 hours")
    land.prune_days(t.spark, path, cutoff, t.as_of, V.resolve(t.landing(), LAND_KEYS), LAND_KEYS)
    return land.read_landing(t.spark, path).select("landing_id", "sp_start_utc")


@query(
    "l8_prune_manifest",
    "landing",
    f"""SELECT CAST(sp_start_utc AS DATE) AS day, count(*) AS rows, min(sp_start_utc) AS least,
    max(sp_start_utc) AS greatest FROM (SELECT sp_start_utc FROM landing QUALIFY {_OLD_DAY})
    GROUP BY 1""",
)
def l8_manifest(t):
    """What went, a row a folder."""
    path = landed(t, "manifest")
    cutoff = t.as_of - F.expr("interval 7 days 9 hours")
    went = land.prune_days(t.spark, path, cutoff, t.as_of, V.resolve(t.landing(), LAND_KEYS), LAND_KEYS)
    return went.select("day", "rows", "least", "greatest")


@query(
    "a31_retention_report",
    "landing",
    f"""SELECT count(*) FILTER (WHERE sp_start_utc < {AS_OF} - INTERVAL '7 days') AS delete_count,
    count(*) FILTER (WHERE sp_start_utc >= {AS_OF} - INTERVAL '7 days') AS keep_count,
    count(*) AS total_count, min(sp_start_utc) AS oldest, max(sp_start_utc) AS newest
    FROM landing""",
)
def a31(t):
    return V.retention_report(t.landing(), "sp_start_utc", 7, t.as_of)


@query(
    "j1_resolve",
    "landing",
    """SELECT l.series_key, l.sp_start_utc, l.landing_id, l.payload, h.revision_count,
    h.first_seen_at_utc FROM (SELECT * FROM landing
      QUALIFY row_number() OVER (PARTITION BY series_key, sp_start_utc
        ORDER BY fetched_at_utc DESC, landing_id DESC) = 1) l
    JOIN (SELECT series_key, sp_start_utc, count(*) AS revision_count,
      min(fetched_at_utc) AS first_seen_at_utc FROM landing GROUP BY 1, 2) h
    USING (series_key, sp_start_utc)""",
)
def j1(t):
    return V.resolve(t.landing(), LAND_KEYS).select(
        *LAND_KEYS, "landing_id", "payload", "revision_count", "first_seen_at_utc"
    )


@query(
    "p1_stg_intensity",
    "landing",
    """SELECT series_key, sp_start_utc,
    CAST(json_extract_string(payload, '$.k') AS INTEGER) AS actual,
    CAST(json_extract_string(payload, '$.f') AS INTEGER) AS benchmark,
    fetched_at_utc AS knowable_at_utc, first_seen_at_utc, revision_count,
    first_seen_at_utc > sp_start_utc + INTERVAL '30 days' AS knowable_is_reconstructed
    FROM (SELECT *, count(*) OVER w AS revision_count, min(fetched_at_utc) OVER w
            AS first_seen_at_utc FROM landing
          WINDOW w AS (PARTITION BY series_key, sp_start_utc))
    QUALIFY row_number() OVER (PARTITION BY series_key, sp_start_utc
      ORDER BY fetched_at_utc DESC, landing_id DESC) = 1""",
)
def p1(t):
    from tidemark.plans.staging import stg_intensity

    return stg_intensity(t.landing(), LAND_KEYS, "k", "f")


@query(
    "a9_conflicting_versions",
    "landing",
    """SELECT series_key, sp_start_utc, count(*) AS versions,
    count(DISTINCT fetched_at_utc) AS distinct_fetch_times,
    count(DISTINCT payload_hash) AS distinct_payloads,
    count(*) > count(DISTINCT fetched_at_utc) AS ordering_is_ambiguous,
    unnest(list(landing_id ORDER BY landing_id)) AS landing_id,
    unnest(list(json_extract_string(payload, '$.k') ORDER BY landing_id)) AS k,
    unnest(range(1, count(*) + 1)) AS position
    FROM landing GROUP BY 1, 2 HAVING count(*) > 1""",
)
def a9(t):
    rows = t.landing().withColumn("k", F.get_json_object("payload", "$.k"))
    return V.conflicting_versions(rows, LAND_KEYS, ["k"])


@query(
    "s12_append_new",
    "landing",
    """SELECT series_key, sp_start_utc, landing_id FROM landing
    QUALIFY row_number() OVER (PARTITION BY landing_id) = 1""",
)
def s12(t):
    path = scratch_dir(t.spark, "append")
    first, _ = halves(t)
    grain = ["landing_id"]
    S.append_new(t.spark, first, path, grain)
    S.append_new(t.spark, t.landing(), path, grain)
    return t.spark.read.parquet(path).select("series_key", "sp_start_utc", "landing_id")


def _daily(df):
    return df.withColumn("day", F.to_date("sp_start_utc"))


_FINAL = """SELECT series_key, sp_start_utc, actual, revision_count FROM panel"""
FACT_KEYS = ["series_key", "sp_start_utc"]


@query("t1_upsert_with_lookback", "panel", _FINAL)
def t1(t):
    """The panel built from a first load and an update that restates its last days."""
    path = scratch_dir(t.spark, "fact")
    rows = _daily(t.panel().select(*FACT_KEYS, "actual", "revision_count"))
    early = rows.where(F.col("sp_start_utc") < F.lit("2024-01-25").cast("timestamp"))
    stale = F.when(F.col("day") >= F.lit("2024-01-20").cast("date"), 0).otherwise(1)
    stale = (F.col("actual") * stale).cast(dict(rows.dtypes)["actual"])
    S.upsert(t.spark, path, early.withColumn("actual", stale), FACT_KEYS, "day")
    since = marts.incremental_since(t.spark.read.parquet(path), t.as_of)
    S.upsert(t.spark, path, rows.where(F.col("sp_start_utc") >= since), FACT_KEYS, "day")
    return t.spark.read.parquet(path).drop("day")


@query(
    "t2_accumulate_upsert",
    "weather_hour",
    """SELECT location_id, hour_start_utc, temperature_2m_c,
    CASE WHEN hour_start_utc >= TIMESTAMP '2024-01-24' AND hour(hour_start_utc) % 2 = 0
      THEN wind_speed_100m_kmh + 1 ELSE wind_speed_100m_kmh END AS wind_speed_100m_kmh
    FROM weather_hour""",
)
def t2(t):
    """Hourly weather after its source was pruned to even hours of the newest days, and revised."""
    path = scratch_dir(t.spark, "weather")
    keys = ["location_id", "hour_start_utc"]
    rows = t.weather_hour().select(*keys, "wind_speed_100m_kmh", "temperature_2m_c")
    rows = rows.withColumn("day", F.to_date("hour_start_utc"))
    S.upsert(t.spark, path, rows, keys, "day")
    kept = rows.where(F.col("day") >= F.lit("2024-01-24").cast("date"))
    kept = kept.where(F.hour("hour_start_utc") % 2 == 0)
    wind = "wind_speed_100m_kmh"
    revised = kept.withColumn(wind, (F.col(wind) + 1).cast(kept.schema[wind].dataType))
    S.upsert(t.spark, path, revised.select(*rows.columns), keys, "day")
    return t.spark.read.parquet(path).drop("day")


_MID = "TIMESTAMP '2024-01-20 00:00:00'"


@query(
    "t3_lifecycle",
    "panel",
    f"""SELECT series_key, sp_start_utc, CASE
    WHEN (actual IS NULL OR hour(sp_start_utc) = 5) AND {_MID} - sp_start_utc > INTERVAL '24 hours'
      THEN 'unscoreable'
    WHEN {_MID} - sp_start_utc > INTERVAL '24 hours'
      AND (revision_count = 1 OR {_MID} - knowable_at_utc > INTERVAL '6 hours') THEN 'matured'
    ELSE 'pending' END AS state FROM panel""",
)
def t3(t):
    """The states in mid-history, of a panel without the actuals of one hour: each state occurs."""
    lost = F.when(F.hour("sp_start_utc") != 5, F.col("actual"))
    facts = marts.fct_intensity_period(
        t.panel().withColumn("actual", lost), t.absent(), F.lit("2024-01-20").cast("timestamp")
    )
    return V.lifecycle(facts).select("series_key", "sp_start_utc", "state")


@query(
    "t4_land_stream",
    "busy",
    f"""SELECT series_key, sp_start_utc, landing_id, payload_hash FROM busy
    WHERE landing_id < {_HALF_ID.replace("landing)", "busy)")} UNION ALL ({_CHANGED})""",
)
def t4(t):
    """Two arrivals one after the other, each of many files; the second repeats keys of the first."""
    out, mark, source = (scratch_dir(t.spark, n) for n in ("landing", "marks", "arrivals"))
    for part in halves(t, t.busy()):
        part.write.mode("append").parquet(source)
        land.land_stream(
            t.spark, t.spark.readStream.schema(part.schema).parquet(source), out, mark, LAND_KEYS
        )
    return land.read_landing(t.spark, out).select(*LAND_KEYS, "landing_id", "payload_hash")


@query(
    "x1_landing_ids",
    "landing",
    f"""SELECT series_key, sp_start_utc, payload_hash, fetched_at_utc,
    row_number() OVER (ORDER BY fetched_at_utc, series_key, sp_start_utc, payload_hash)
      + (SELECT max(landing_id) FROM landing WHERE landing_id < {_HALF_ID}) AS landing_id
    FROM landing WHERE landing_id >= {_HALF_ID}""",
)
def x1(t):
    first, second = halves(t)
    ided = V.with_landing_ids(second.drop("landing_id"), V.last_landing_id(first), LAND_KEYS)
    return ided.select(*LAND_KEYS, "payload_hash", "fetched_at_utc", "landing_id")
