"""Spine, coverage, gaps, half-hour facts, mix and weather marts, assertions and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import scalar as X
from tidemark.operators import audits as A
from tidemark.operators import joins as J
from tidemark.operators import ordering as O
from tidemark.operators import quality as Q
from tidemark.plans import marts as M
from tidemark.plans import staging, status
from tidemark.queries.common import AS_OF, query
from tidemark.sources.spine import spine_of
from tidemark.sources.tables import load_history
from tidemark.sources.windows import request_windows
from tidemark.streaming import buckets

KEYS = ["series_key"]
FACT = ["series_key", "sp_start_utc"]


def ts(text: str):
    return F.lit(text).cast("timestamp")


def due_periods(t):
    """The expected periods of every series."""
    names = t.panel().select(*KEYS).distinct()
    bounds = t.events().groupBy(F.col("event_type").alias("series_key")).agg(
        F.date_trunc("day", F.min("ts")).alias("a"),
        (F.date_trunc("day", F.max("ts")) + F.expr("interval 1 day")).alias("b"),
    )
    due = O.explode_grid(bounds.join(names, KEYS, "left_semi"), "a", "b", 1800, "sp_start_utc")
    return due.select(*FACT)


def gaps_of_panel(t):
    """Expected periods of every series that hold no row."""
    return J.missing(due_periods(t), t.panel(), FACT)


_DUE = """(SELECT series_key, unnest(generate_series(a, b, INTERVAL '30 minutes'))
      AS sp_start_utc FROM (SELECT event_type AS series_key,
        CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS a,
        CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL '23 hours 30 minutes' AS b
        FROM events GROUP BY 1))"""
_GAPS = f"SELECT * FROM {_DUE} ANTI JOIN panel USING (series_key, sp_start_utc)"


# ---- windows, spine ---------------------------------------------------------
@query(
    "s8_request_windows",
    "",
    f"""SELECT user_id, chunk_from_utc, least(chunk_from_utc + INTERVAL '3 days', b)
      AS chunk_to_utc FROM (SELECT user_id, b, unnest(generate_series(a,
        b - INTERVAL '1 second', INTERVAL '3 days')) AS chunk_from_utc
      FROM (SELECT user_id, CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS a,
        least(CAST(date_trunc('hour', max(ts)) AS TIMESTAMP), {AS_OF} - INTERVAL '36 hours') AS b
        FROM events GROUP BY 1) WHERE a < b)""",
)
def s8(t):
    spans = t.events().groupBy("user_id").agg(
        F.date_trunc("day", F.min("ts")).alias("window_from_utc"),
        F.date_trunc("hour", F.max("ts")).alias("window_to_utc"),
    )
    clamp = t.as_of - F.expr("interval 36 hours")
    return request_windows(spans, 3 * C.DAY_SECONDS, clamp_to=clamp).select(
        "user_id", "chunk_from_utc", "chunk_to_utc"
    )


@query(
    "s10_bounded_history",
    "panel",
    """SELECT series_key, sp_start_utc, actual FROM panel
    WHERE sp_start_utc >= TIMESTAMP '2024-01-10' AND sp_start_utc <= TIMESTAMP '2024-01-20'
      AND series_key IN ('click', 'view')""",
)
def s10(t):
    return load_history(
        t.panel(), "sp_start_utc", ts("2024-01-10"), ts("2024-01-20"), "series_key",
        ["click", "view"],
    ).select(*FACT, "actual")


@query("s11_spine", "spine", "SELECT sp_start_utc FROM spine")
def s11(t):
    return t.spine()


@query(
    "a27_spine_stats",
    "spine",
    """SELECT count(*) AS periods, min(sp_start_utc) AS first_period_utc,
    max(sp_start_utc) AS last_period_utc FROM spine""",
)
def a27(t):
    return status.spine_stats(t.spine())


@query(
    "w1_w2_settlement_periods",
    "local_spine",
    """SELECT sp_start_utc, sp_start_utc + INTERVAL '30 minutes' AS sp_end_utc,
    CAST(local_ts AS DATE) AS settlement_date_local,
    row_number() OVER (PARTITION BY CAST(local_ts AS DATE) ORDER BY sp_start_utc)
      AS settlement_period_no,
    count(*) OVER (PARTITION BY CAST(local_ts AS DATE)) AS periods_in_local_day,
    local_ts, extract(hour FROM local_ts) AS hour_local, extract(isodow FROM local_ts) AS dow,
    extract(month FROM local_ts) AS month, extract(year FROM local_ts) AS year,
    extract(doy FROM local_ts) AS day_of_year, extract(isodow FROM local_ts) >= 6 AS is_weekend,
    local_ts - sp_start_utc = INTERVAL '1 hour' AS is_bst,
    false AS is_gb_holiday, false AS is_gb_holiday_resolved FROM local_spine""",
)
def w1(t):
    return M.dim_settlement_period(t.long_spine())


@query(
    "n9_n10_local_days",
    "local_spine",
    """SELECT CAST(local_ts AS DATE) AS settlement_date_local, count(*) AS n_periods
    FROM local_spine GROUP BY 1""",
)
def n9(t):
    return Q.day_counts(M.dim_settlement_period(t.long_spine()))


@query(
    "w3_spine_steps",
    "long_spine",
    """SELECT sp_start_utc, CAST(epoch(sp_start_utc - lag(sp_start_utc)
      OVER (ORDER BY sp_start_utc)) AS BIGINT) AS step_seconds FROM long_spine""",
)
def w3(t):
    return O.spine_steps(t.long_spine())


@query(
    "w3_event_steps",
    "panel",
    """SELECT series_key, sp_start_utc, lag(sp_start_utc) OVER (PARTITION BY series_key
      ORDER BY sp_start_utc) AS previous_utc FROM panel""",
)
def w3_panel(t):
    return O.previous_row(t.panel(), KEYS, ["sp_start_utc"], "p").select(
        *FACT, F.col("p.sp_start_utc").alias("previous_utc")
    )


# ---- coverage and gaps ------------------------------------------------------
@query("a30_landed", "landing", "SELECT DISTINCT series_key, sp_start_utc FROM landing")
def a30(t):
    return A.landed(t.landing(), FACT)


@query(
    "a6_coverage_by_year",
    "",
    f"""SELECT extract(year FROM d) AS year, count(*) AS spine_periods,
    count(o) AS landed_periods, count(*) - count(o) AS missing,
    round(100.0 * count(o) / count(*), 3) AS pct_covered
    FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL '1 day')) AS d
          FROM orders) s
    LEFT JOIN (SELECT DISTINCT o_orderdate AS o FROM orders) l ON l.o = s.d
    WHERE d < {AS_OF} GROUP BY 1""",
)
def a6(t):
    days = spine_of(t.orders(), step=C.DAY_SECONDS)
    out = A.coverage_by_year(days, t.orders(), t.as_of)
    return out.withColumn("pct_covered", F.col("pct_covered").cast("double"))


@query(
    "j3_coverage_join",
    "spine hh",
    """SELECT s.sp_start_utc, h.sp_start_utc AS landed_utc FROM spine s
    LEFT JOIN hh h ON h.sp_start_utc = s.sp_start_utc""",
)
def j3(t):
    return J.coverage_join(t.spine(), t.hh())


@query("j4_missing_periods", "panel", _GAPS)
def j4(t):
    return gaps_of_panel(t)


_FIND = f"""SELECT series_key, sp_start_utc FROM {_DUE}
    ANTI JOIN panel USING (series_key, sp_start_utc) ANTI JOIN absent USING (sp_start_utc)
    WHERE sp_start_utc >= {AS_OF} - INTERVAL '28 days'
      AND sp_start_utc < {AS_OF} - INTERVAL '3 hours'"""


@query("g1_find_gaps", "panel absent", _FIND)
def g1(t):
    return status.find_gaps(
        due_periods(t), t.panel(), t.absent(), "hh", t.as_of, 28, keys=KEYS
    )


@query(
    "j5_missing_unexcused",
    "spine user_panel absent",
    """SELECT s.sp_start_utc FROM spine s WHERE NOT EXISTS (SELECT 1 FROM user_panel p
      WHERE p.sp_start_utc = s.sp_start_utc AND p.revision_count > 1)
    AND NOT EXISTS (SELECT 1 FROM absent a WHERE a.sp_start_utc = s.sp_start_utc)""",
)
def j5(t):
    busy = t.user_panel().where(F.col("revision_count") > 1)
    return J.missing_unexcused(t.spine(), busy, t.absent(), "hh")


@query(
    "w4_islands",
    "panel",
    f"""SELECT series_key, min(sp_start_utc) AS gap_start_utc, max(sp_start_utc) AS gap_end_utc,
    count(*) AS periods, round(count(*) / 2.0, 1) AS hours
    FROM (SELECT *, sp_start_utc - row_number() OVER (PARTITION BY series_key
            ORDER BY sp_start_utc) * INTERVAL '30 minutes' AS island FROM ({_GAPS}))
    GROUP BY series_key, island""",
)
def w4(t):
    return O.islands(gaps_of_panel(t), KEYS)


_WINDOWS = f"""SELECT series_key, min(sp_start_utc) AS window_from_utc,
    max(sp_start_utc) + INTERVAL '30 minutes' AS window_to_utc, count(*) AS periods
    FROM (SELECT *, sp_start_utc - row_number() OVER (PARTITION BY series_key
            ORDER BY sp_start_utc) * INTERVAL '30 minutes' AS island FROM ({_GAPS}))
    GROUP BY series_key, island"""


@query("w5_coalesced_windows", "panel", _WINDOWS)
def w5(t):
    return O.coalesce_periods(gaps_of_panel(t), KEYS)


@query("t6_outage_sessions", "panel", _WINDOWS)
def t6(t):
    return buckets.sessions(gaps_of_panel(t), keys=KEYS)


@query(
    "g2_heal_plan",
    "panel",
    f"""SELECT series_key, chunk_from_utc, least(chunk_from_utc + INTERVAL '28 days', window_to_utc)
      AS chunk_to_utc, periods FROM (
        SELECT *, unnest(generate_series(window_from_utc, window_to_utc - INTERVAL '1 second',
          INTERVAL '28 days')) AS chunk_from_utc FROM ({_WINDOWS}))""",
)
def g2(t):
    return status.heal_plan(gaps_of_panel(t), C.SOURCES["ci_intensity"], KEYS).select(
        *KEYS, "chunk_from_utc", "chunk_to_utc", "periods"
    )


@query(
    "g2_heal_outcome",
    "spine hh panel",
    f"""SELECT count(*) AS missing, count(h.sp_start_utc) AS healed,
    count(h.sp_start_utc) < count(*) AS is_partial
    FROM (SELECT DISTINCT sp_start_utc FROM ({_GAPS})) g
    LEFT JOIN hh h ON h.sp_start_utc = g.sp_start_utc""",
)
def g2_outcome(t):
    return status.heal_outcome(gaps_of_panel(t).select("sp_start_utc").distinct(), t.hh())


@query(
    "u4_difference",
    "spine hh",
    "SELECT sp_start_utc FROM spine EXCEPT SELECT sp_start_utc FROM hh",
)
def u4(t):
    return J.missing(t.spine(), t.hh())


@query(
    "j7_expand_windows",
    "panel",
    f"SELECT series_key, sp_start_utc FROM ({_GAPS})",
)
def j7(t):
    """The windows of every gap, expanded to the periods that are missing."""
    windows = O.coalesce_periods(gaps_of_panel(t), KEYS)
    return J.expand_windows(windows, t.spine()).select(*KEYS, "sp_start_utc")


@query(
    "j2_flag_absent",
    "panel absent",
    """SELECT p.series_key, p.sp_start_utc, a.sp_start_utc IS NOT NULL AS is_known_absent
    FROM panel p LEFT JOIN absent a ON a.sp_start_utc = p.sp_start_utc""",
)
def j2(t):
    return J.flag_absent(t.panel(), t.absent()).select(*FACT, "is_known_absent")


@query(
    "t5_half_hour_buckets",
    "panel",
    "SELECT series_key, sp_start_utc, actual, revision_count FROM panel",
)
def t5(t):
    rows = t.events().withColumnRenamed("event_type", "series_key")
    return buckets.bucket(
        rows,
        [F.sum("v").cast("decimal(14,2)").alias("actual"), F.count(F.lit(1)).alias("revision_count")],
        keys=KEYS,
    )


# ---- facts ------------------------------------------------------------------
@query(
    "p7_p10_intensity_facts",
    "facts",
    """SELECT series_key, sp_start_utc, actual, benchmark, benchmark_error, revision_count,
    is_matured, is_permanently_unscoreable, benchmark_missing, is_benchmark_plausible,
    is_comparable, is_known_absent_upstream FROM facts""",
)
def p7(t):
    return t.built_facts().drop("first_seen_at_utc", "knowable_at_utc")


@query(
    "p13_horizon_group",
    "points",
    """SELECT series_key, model_version, run_at_utc, horizon, CASE WHEN horizon <= 6 THEN 'H1'
    WHEN horizon <= 24 THEN 'H2' WHEN horizon <= 48 THEN 'H3' ELSE 'H4' END AS horizon_group
    FROM points""",
)
def p13(t):
    """Every issued forecast in its group."""
    return t.points().select(
        "series_key", "model_version", "run_at_utc", "horizon",
        X.horizon_group("horizon").alias("horizon_group"),
    )


@query(
    "p14_optional_filter",
    "panel",
    "SELECT series_key, sp_start_utc, actual FROM panel WHERE series_key = 'view'",
)
def p14(t):
    rows = X.opt_filter(t.panel(), "series_key", "view")
    return X.opt_filter(rows, "revision_count", None).select(*FACT, "actual")


@query(
    "p15_effective_knowable",
    "panel",
    """SELECT series_key, sp_start_utc, CASE WHEN revision_count > 1
      THEN sp_start_utc + INTERVAL '24 hours' ELSE knowable_at_utc END AS knowable_effective_utc
    FROM panel""",
)
def p15(t):
    flag = F.col("revision_count") > 1
    return t.panel().select(
        *FACT,
        X.effective_knowable("sp_start_utc", "knowable_at_utc", flag).alias(
            "knowable_effective_utc"
        ),
    )


@query(
    "p4_p11_demand_vintages",
    "vintage",
    """SELECT sp_start_utc, user_id, publish_time_utc,
    strftime(sp_start_utc, '%Y-%m-%d %H:%M:%S') || '|' ||
      strftime(publish_time_utc, '%Y-%m-%d %H:%M:%S') AS demand_key,
    round(epoch_us(publish_time_utc) / 60000000.0 - epoch_us(sp_start_utc) / 60000000.0)
      AS publish_lag_minutes FROM vintage""",
)
def p4(t):
    return M.fct_demand_period(t.vintage()).select(
        "sp_start_utc", "user_id", "publish_time_utc", "demand_key", "publish_lag_minutes"
    )


# ---- mix and weather --------------------------------------------------------
@query(
    "p2_unnest_mix",
    "mix",
    """SELECT sp_start_utc, fuel, perc, is_low_carbon, is_fossil,
    strftime(sp_start_utc, '%Y-%m-%d %H:%M:%S') || '|' || fuel AS mix_key FROM mix""",
)
def p2(t):
    rows = staging.unnest_mix(t.mix_json(), ["sp_start_utc"], "mix_json")
    return M.fct_generation_mix(rows).drop("knowable_at_utc")


@query("a1_mix_wide", "mix_wide", "SELECT * FROM mix_wide")
def a1(t):
    return t.mix_wide()


@query("a2_weather_wide", "weather_wide", "SELECT * FROM weather_wide")
def a2(t):
    return t.weather_wide()


@query(
    "a3_dim_region",
    "",
    """SELECT n_regionkey AS region_id, max(n_name) AS region_shortname,
    max(c_mktsegment) AS dno_region, false AS is_scoreable, count(*) AS observed_periods
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def a3(t):
    rows = t.raw("customer").join(
        t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return M.dim_region(
        rows.select(
            F.col("n_regionkey").alias("region_id"),
            F.col("n_name").alias("region_shortname"),
            F.col("c_mktsegment").alias("dno_region"),
        )
    )


@query(
    "j9_align_hourly",
    "weather_period",
    """SELECT sp_start_utc, location_id, wind_speed_100m_kmh, 'step_hold' AS alignment_method,
    strftime(sp_start_utc, '%Y-%m-%d %H:%M:%S') || '|' || location_id AS weather_key
    FROM weather_period""",
)
def j9(t):
    return t.weather_period().select(
        "sp_start_utc", "location_id", "wind_speed_100m_kmh", "alignment_method", "weather_key"
    )


@query(
    "j12_weather_mix",
    "weather_period mix_wide",
    """SELECT w.sp_start_utc, location_id, wind_speed_100m_kmh, wind_perc FROM weather_period w
    JOIN mix_wide m ON m.sp_start_utc = w.sp_start_utc""",
)
def j12(t):
    return J.weather_mix(t.weather_period(), t.mix_wide()).select(
        "sp_start_utc", "location_id", "wind_speed_100m_kmh", "wind_perc"
    )


@query(
    "j11_with_bounds",
    "panel spine",
    """SELECT series_key, sp_start_utc, (SELECT min(sp_start_utc) FROM spine) AS first_utc,
    (SELECT max(sp_start_utc) FROM spine) AS last_utc FROM panel""",
)
def j11(t):
    bounds = t.spine().agg(
        F.min("sp_start_utc").alias("first_utc"), F.max("sp_start_utc").alias("last_utc")
    )
    return J.with_bounds(t.panel().select(*FACT), bounds)


# ---- audits -----------------------------------------------------------------
@query(
    "a7_u1_source_spans",
    "landing panel weather_hour vintage spine",
    f"""WITH s AS (
      SELECT 'landing' AS source, min(sp_start_utc) AS a, max(sp_start_utc) AS b,
        count(DISTINCT sp_start_utc) AS periods FROM landing
      UNION ALL SELECT 'panel', min(sp_start_utc), max(sp_start_utc),
        count(DISTINCT sp_start_utc) FROM panel
      UNION ALL SELECT 'weather', min(hour_start_utc), max(hour_start_utc),
        count(DISTINCT hour_start_utc) FROM weather_hour
      UNION ALL SELECT 'demand', min(sp_start_utc), max(sp_start_utc),
        count(DISTINCT sp_start_utc) FROM vintage)
    SELECT source, CAST(a AS DATE) AS covers_from, CAST(b AS DATE) AS covers_to, periods,
    CASE WHEN b IS NULL THEN 0 ELSE round(100.0 * (CAST(b AS DATE) - CAST(a AS DATE)) /
      nullif((SELECT max(CAST(sp_start_utc AS DATE)) - min(CAST(sp_start_utc AS DATE))
              FROM spine WHERE sp_start_utc < {AS_OF}), 0), 1) END AS pct_of_history_span
    FROM s""",
)
def a7(t):
    tables = {
        "landing": (t.landing(), "sp_start_utc"),
        "panel": (t.panel(), "sp_start_utc"),
        "weather": (t.weather_hour(), "hour_start_utc"),
        "demand": (t.vintage(), "sp_start_utc"),
    }
    return A.source_spans(tables, t.spine(), t.as_of)


@query(
    "a02_structural_gaps",
    "spine user_panel",
    f"""SELECT min(sp_start_utc) AS gap_start_utc, max(sp_start_utc) AS gap_end_utc,
    count(*) AS periods, round(count(*) / 2.0, 1) AS hours FROM (
      SELECT *, sp_start_utc - row_number() OVER (ORDER BY sp_start_utc)
        * INTERVAL '30 minutes' AS island FROM spine
      ANTI JOIN (SELECT DISTINCT sp_start_utc FROM user_panel WHERE revision_count > 1)
        USING (sp_start_utc) WHERE sp_start_utc < {AS_OF}) GROUP BY island""",
)
def a02(t):
    busy = t.user_panel().where(F.col("revision_count") > 1)
    return A.structural_gaps(t.spine(), busy, t.as_of)


@query(
    "a8_unscoreable_by_year",
    "landing",
    f"""SELECT extract(year FROM sp_start_utc) AS year, count(*) AS periods,
    count(*) FILTER (WHERE json_extract_string(payload, '$.k') IS NULL) AS null_actual,
    round(100.0 * count(*) FILTER (WHERE json_extract_string(payload, '$.k') IS NULL)
      / count(*), 3) AS pct_null_actual,
    count(*) FILTER (WHERE json_extract_string(payload, '$.f') IS NULL) AS null_benchmark
    FROM (SELECT * FROM landing QUALIFY row_number() OVER (PARTITION BY series_key, sp_start_utc
      ORDER BY fetched_at_utc DESC, landing_id DESC) = 1)
    WHERE sp_start_utc < {AS_OF} - INTERVAL '7 days' GROUP BY 1""",
)
def a8(t):
    return A.unscoreable_by_year(t.landing(), t.as_of, FACT, "k", "f")


def banded(t):
    return t.panel().select(
        "sp_start_utc",
        "actual",
        F.when(F.col("revision_count") == 1, "low")
        .when(F.col("revision_count") == 2, "moderate")
        .otherwise("high")
        .alias("band"),
    )


_BANDED = """(SELECT sp_start_utc, actual, CASE revision_count WHEN 1 THEN 'low'
    WHEN 2 THEN 'moderate' ELSE 'high' END AS band FROM panel)"""


@query(
    "a10_band_ranges",
    "panel",
    f"""SELECT band, count(*) AS periods, min(actual) AS min_actual, max(actual) AS max_actual,
    min(extract(year FROM sp_start_utc)) AS first_year,
    max(extract(year FROM sp_start_utc)) AS last_year FROM {_BANDED} GROUP BY 1""",
)
def a10(t):
    return A.band_ranges(banded(t))


@query(
    "a11_band_drift",
    "panel",
    f"""SELECT extract(doy FROM sp_start_utc) AS year,
    max(actual) FILTER (WHERE band = 'moderate') AS highest_moderate,
    min(actual) FILTER (WHERE band = 'high') AS lowest_high,
    max(actual) FILTER (WHERE band = 'low') AS highest_low,
    min(actual) FILTER (WHERE band = 'moderate') AS lowest_moderate FROM {_BANDED} GROUP BY 1""",
)
def a11(t):
    return A.band_drift(banded(t), by=F.dayofyear("sp_start_utc"))


@query(
    "a12_mix_sum_distribution",
    "mix_wide",
    """SELECT CAST(round(total_perc, 1) AS DECIMAL(20,1)) AS mix_sum, count(*) AS periods,
    round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct_of_all FROM mix_wide GROUP BY 1""",
)
def a12(t):
    out = A.mix_sum_distribution(A.array_sums(t.mix_json()))
    return out.withColumn("mix_sum", F.col("mix_sum").cast("decimal(20,1)")).withColumn(
        "pct_of_all", F.col("pct_of_all").cast("double")
    )


@query(
    "a13_fuel_sets",
    "mix",
    """SELECT extract(doy FROM sp_start_utc) AS year, count(DISTINCT fuel) AS distinct_fuels,
    string_agg(DISTINCT fuel, ', ' ORDER BY fuel) AS fuel_set FROM mix GROUP BY 1""",
)
def a13(t):
    return A.fuel_sets(t.mix(), F.dayofyear("sp_start_utc"))


@query(
    "a14_publication_lag",
    "vintage",
    """SELECT count(*) AS observations, count(DISTINCT sp_start_utc) AS periods,
    round(min(m)) AS min_lag_min, round(max(m)) AS max_lag_min,
    count(*) FILTER (WHERE m < 0) AS impossible_negative_lags,
    round(quantile_cont(m, 0.5)) AS p50_lag_min, round(quantile_cont(m, 0.95)) AS p95_lag_min,
    round(quantile_cont(m, 0.99)) AS p99_lag_min
    FROM (SELECT *, (epoch_us(publish_time_utc) - epoch_us(sp_start_utc)) / 1e6 / 60 AS m
          FROM vintage)""",
)
def a14(t):
    return A.publication_lag(t.vintage())


@query(
    "a15_location_correlation",
    "weather_period mix_wide",
    """SELECT location_id, count(*) AS observations,
    round(corr(CAST(wind_speed_100m_kmh AS DOUBLE), CAST(wind_perc AS DOUBLE)), 4)
      AS corr_wind_share,
    round(corr(CAST(temperature_2m_c AS DOUBLE), CAST(wind_perc AS DOUBLE)), 4)
      AS corr_temp_wind_share,
    round(corr(CAST(shortwave_radiation_wm2 AS DOUBLE), CAST(solar_perc AS DOUBLE)), 4)
      AS corr_solar_share,
    round(avg(CAST(wind_speed_100m_kmh AS DOUBLE)), 1) AS mean_wind_kmh
    FROM weather_period w JOIN mix_wide m ON m.sp_start_utc = w.sp_start_utc
    WHERE wind_perc IS NOT NULL GROUP BY 1""",
)
def a15(t):
    return A.location_corr(t.weather_period(), t.mix_wide())


# ---- assertions -------------------------------------------------------------
@query(
    "q1_unique",
    "",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2
    HAVING count(*) > 1""",
)
def q1_unique(t):
    return Q.check_unique(t.raw("lineitem"), "l_orderkey", "l_linenumber")


@query(
    "q1_not_null",
    "facts",
    """SELECT 'benchmark' AS "column", count(*) AS nulls FROM facts WHERE benchmark IS NULL
    HAVING count(*) > 0""",
)
def q1_not_null(t):
    return Q.check_not_null(t.facts(), "series_key", "sp_start_utc", "actual", "benchmark")


@query(
    "q1_accepted_values",
    "",
    """SELECT event_type, count(*) AS n FROM events
    WHERE event_type NOT IN ('click', 'view', 'signup') GROUP BY 1""",
)
def q1_accepted(t):
    return Q.check_accepted(t.events(), "event_type", ["click", "view", "signup"])


@query(
    "q2_category_count",
    "mix",
    """SELECT sp_start_utc, count(*) AS fuels_reported FROM mix GROUP BY 1
    HAVING count(*) <> 5""",
)
def q2(t):
    return Q.check_category_count(t.mix(), 5)


@query(
    "q3_physical_range",
    "panel",
    """SELECT series_key, sp_start_utc, actual, benchmark FROM panel
    WHERE actual < 0 OR actual > 150 OR benchmark < 0 OR benchmark > 140""",
)
def q3(t):
    rows = t.panel().select(*FACT, "actual", "benchmark")
    return Q.check_range(rows, {"actual": (0, 150), "benchmark": (0, 140)})


@query(
    "q4_matured_have_actual",
    "facts",
    """SELECT 'matured_have_actual' AS assertion, count(*) AS rows_checked,
    count(*) FILTER (WHERE is_matured AND (actual IS NULL OR hour(sp_start_utc) = 5)
      AND NOT is_permanently_unscoreable AND NOT is_known_absent_upstream) AS violations,
    count(*) > 0 AND count(*) FILTER (WHERE is_matured AND (actual IS NULL OR hour(sp_start_utc) = 5)
      AND NOT is_permanently_unscoreable AND NOT is_known_absent_upstream) = 0 AS passed FROM facts""",
)
def q4(t):
    """A mart that lost the actuals of one hour of the day."""
    lost = F.when(F.hour("sp_start_utc") != 5, F.col("actual"))
    facts = t.facts().withColumn("actual", lost)
    return Q.status_of("matured_have_actual", Q.check_matured_have_actual(facts), facts)


@query(
    "q5_mix_sums",
    "mix_wide",
    """SELECT sp_start_utc, total_perc FROM mix_wide WHERE abs(total_perc - 100) > 0.005""",
)
def q5(t):
    return Q.check_sum(t.mix_wide(), 100, 0.005).select("sp_start_utc", "total_perc")


@query(
    "q7_periods_per_local_day",
    "local_spine",
    """WITH d AS (SELECT CAST(local_ts AS DATE) AS day, count(*) AS n FROM local_spine GROUP BY 1)
    SELECT 'periods_per_day' AS assertion, (SELECT count(*) FROM long_spine) AS rows_checked,
    count(*) FILTER (WHERE day > (SELECT min(day) FROM d) AND day < (SELECT max(day) FROM d)
      AND n NOT IN (46, 48, 50)) AS violations, violations = 0 AS passed FROM d""",
)
def q7(t):
    dim = M.dim_settlement_period(t.long_spine())
    return Q.status_of("periods_per_day", Q.check_periods_per_day(dim), dim)


@query(
    "q8_spine_step",
    "long_spine",
    """SELECT 'spine_step' AS assertion, count(*) AS rows_checked,
    count(*) FILTER (WHERE s <> INTERVAL '30 minutes') AS violations, violations = 0 AS passed
    FROM (SELECT sp_start_utc - lag(sp_start_utc) OVER (ORDER BY sp_start_utc) AS s
          FROM long_spine)""",
)
def q8(t):
    spine = t.long_spine()
    return Q.status_of("spine_step", Q.check_spine_step(spine), spine)


@query(
    "q9_j13_clock_changes",
    "local_spine",
    """WITH d AS (SELECT CAST(local_ts AS DATE) AS day, count(*) AS n FROM local_spine GROUP BY 1),
    y AS (SELECT year(day) AS yr FROM d GROUP BY 1 HAVING min(day) = make_date(year(min(day)), 1, 1)
      AND max(day) = make_date(year(min(day)), 12, 31))
    SELECT y.yr, count(*) FILTER (WHERE n <> 48) AS non_48_day_count
    FROM y JOIN d ON year(d.day) = y.yr GROUP BY 1""",
)
def q9(t):
    return Q.clock_changes(M.dim_settlement_period(t.long_spine()))


@query(
    "q10_feature_lineage",
    "mix_wide weather_wide",
    """SELECT m.sp_start_utc, wind_perc, wind_speed_100m_kmh__north_sea FROM mix_wide m
    LEFT JOIN weather_wide w ON w.sp_start_utc = m.sp_start_utc""",
)
def q10(t):
    """Feature inputs, refused when a banned table stands anywhere behind them."""
    rows = t.mix_wide().join(t.weather_wide(), "sp_start_utc", "left").select(
        "sp_start_utc", "wind_perc", "wind_speed_100m_kmh__north_sea"
    )
    return Q.check_lineage(rows, ["lnd_om_archive", "stg_om_archive", "fct_demand_current"])


@query(
    "q11_x22_mart_is_current",
    "panel",
    """SELECT 'mart_is_current' AS assertion, count(*) AS rows_checked,
    count(*) FILTER (WHERE revision_count > 1 AND actual IS NOT NULL) AS violations,
    count(*) > 0 AND count(*) FILTER (WHERE revision_count > 1 AND actual IS NOT NULL) = 0 AS passed
    FROM panel""",
)
def x22(t):
    """A mart that froze before the last revision of what was revised."""
    older = F.when(F.col("revision_count") > 1, F.col("actual") - 1).otherwise(F.col("actual"))
    facts = t.facts()
    facts = facts.withColumn("actual", older.cast(facts.schema["actual"].dataType))
    stale = Q.check_mart_is_current(facts, t.panel(), FACT)
    return Q.status_of("mart_is_current", stale, facts)


# ---- scalar functions -------------------------------------------------------
@query(
    "n_scalar_functions",
    "",
    """SELECT event_id, json_extract_string(props, '$.k') AS k_text,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_int,
    CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_utc,
    CAST(date_trunc('month', ts) AS TIMESTAMP) AS month_utc,
    time_bucket(INTERVAL '30 minutes', ts) AS anchor_utc,
    extract(hour FROM ts) AS hour_of_day, extract(isodow FROM ts) AS dow,
    extract(isodow FROM ts) - 1 AS weekday_mon0, extract(month FROM ts) AS month_no,
    extract(year FROM ts) AS year_no, extract(doy FROM ts) AS day_of_year,
    extract(hour FROM ts) * 2 + CASE WHEN extract(minute FROM ts) >= 30 THEN 1 ELSE 0 END AS pod,
    (epoch_us(ts) - epoch_us(CAST(date_trunc('day', ts) AS TIMESTAMP))) / 1e6 AS seconds_in_day,
    timezone('Europe/London', timezone('UTC', ts)) AS local_ts,
    timezone('Europe/London', timezone('UTC', ts)) - ts = INTERVAL '1 hour' AS is_dst,
    ts + INTERVAL '45 minutes' AS later_utc, make_date(year(ts), 1, 1) AS new_year,
    abs(value - 10) AS distance, value * value AS squared, greatest(value, 5.0) AS at_least_5,
    sqrt(value) AS root, round(value, 1) AS rounded, nullif(event_type, 'error') AS no_error,
    coalesce(nullif(event_type, 'error'), 'none') AS filled, value BETWEEN 1 AND 20 AS in_range,
    event_type IN ('click', 'view') AS is_browse, nullif(event_type, 'error') IS NULL AS is_null,
    round(sin(2 * pi() * extract(doy FROM ts) / 365.25), 9) AS sin_doy,
    round(cos(2 * pi() * extract(doy FROM ts) / 365.25), 9) AS cos_doy,
    event_type || '|' || user_id AS text_key, hex(event_type) AS hexed, sha256(props) AS hashed,
    substring(event_type, 1, 3) AS clipped, value IS NOT NULL AND NOT isnan(value) AS finite,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso FROM events""",
)
def n_scalar(t):
    s, c = X.cyclic(F.dayofyear("ts"), 365.25)
    no_error = F.nullif("event_type", F.lit("error"))
    return t.events().select(
        "event_id",
        X.json_get("props", "k").alias("k_text"),
        X.json_text("props", "k", "int").alias("k_int"),
        F.date_trunc("hour", "ts").alias("hour_utc"),
        F.date_trunc("month", "ts").alias("month_utc"),
        X.floor_to("ts").alias("anchor_utc"),
        F.hour("ts").alias("hour_of_day"),
        X.isodow("ts").alias("dow"),
        X.weekday_mon0("ts").alias("weekday_mon0"),
        F.month("ts").alias("month_no"),
        F.year("ts").alias("year_no"),
        F.dayofyear("ts").alias("day_of_year"),
        X.period_of_day("ts").alias("pod"),
        X.seconds_between("ts", F.date_trunc("day", "ts")).alias("seconds_in_day"),
        X.to_local("ts").cast("timestamp_ntz").alias("local_ts"),
        X.is_dst("ts").alias("is_dst"),
        (F.col("ts") + F.expr("interval 45 minutes")).alias("later_utc"),
        F.make_date(F.year("ts"), F.lit(1), F.lit(1)).alias("new_year"),
        F.abs(F.col("value") - 10).alias("distance"),
        (F.col("value") * F.col("value")).alias("squared"),
        F.greatest("value", F.lit(5.0)).alias("at_least_5"),
        F.sqrt("value").alias("root"),
        F.round("value", 1).alias("rounded"),
        no_error.alias("no_error"),
        F.coalesce(no_error, F.lit("none")).alias("filled"),
        F.col("value").between(1, 20).alias("in_range"),
        F.col("event_type").isin("click", "view").alias("is_browse"),
        no_error.isNull().alias("is_null"),
        F.round(s, 9).alias("sin_doy"),
        F.round(c, 9).alias("cos_doy"),
        X.text_key("event_type", "user_id").alias("text_key"),
        F.hex("event_type").alias("hexed"),
        F.sha2("props", 256).alias("hashed"),
        X.clip("event_type", 3).alias("clipped"),
        X.is_finite("value").alias("finite"),
        X.iso_text("ts").alias("iso"),
    )


@query(
    "n36_zip_arrays",
    "weather_hour",
    """SELECT location_id, hour_start_utc, wind_speed_100m_kmh, temperature_2m_c
    FROM weather_hour""",
)
def n36(t):
    """Hours packed into parallel arrays per location and day, and opened again."""
    cols = ["hour_start_utc", "wind_speed_100m_kmh", "temperature_2m_c"]
    packed = t.weather_hour().groupBy("location_id", F.to_date("hour_start_utc").alias("d")).agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("h")
    )
    arrays = packed.select("location_id", *[F.col(f"h.{c}").alias(c) for c in cols])
    rows = arrays.select("location_id", F.explode(F.arrays_zip(*cols)).alias("z"))
    return rows.select("location_id", *[F.col(f"z.{c}").alias(c) for c in cols]).where(
        ~X.all_null("wind_speed_100m_kmh", "temperature_2m_c")
    )
