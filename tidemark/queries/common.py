"""Registry of queries, and the SQL views their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.fixtures.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_FUEL = (
    "CASE event_type WHEN 'click' THEN 'wind' WHEN 'error' THEN 'coal' "
    "WHEN 'purchase' THEN 'gas' WHEN 'signup' THEN 'solar' WHEN 'view' THEN 'nuclear' END"
)
_PLACE = (
    "CASE event_type WHEN 'click' THEN 'north_sea' WHEN 'error' THEN 'irish_sea' "
    "WHEN 'purchase' THEN 'midlands' WHEN 'signup' THEN 'south_coast' "
    "WHEN 'view' THEN 'scotland_south' END"
)
_HALF = "time_bucket(INTERVAL '30 minutes', ts)"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
GROUP = (
    "CASE WHEN horizon <= 6 THEN 'H1' WHEN horizon <= 24 THEN 'H2' "
    "WHEN horizon <= 48 THEN 'H3' ELSE 'H4' END"
)


def _halves(key: str, benchmark: str, extra: str = "") -> str:
    return f"""SELECT {key} AS series_key, {_HALF} AS sp_start_utc,
      CAST(sum(v) AS DECIMAL(14,2)) AS actual,
      CAST(sum(v) FILTER (WHERE {benchmark}) AS DECIMAL(14,2)) AS benchmark,
      min(ts) AS first_seen_at_utc, max(ts) AS knowable_at_utc, count(*) AS revision_count
      {extra} FROM ev GROUP BY 1, 2"""


# name -> (views it reads, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT *, CAST(value AS DECIMAL(12,2)) AS v FROM events"),
    "landing": (
        (),
        """SELECT event_id AS landing_id, user_id AS series_key,
        CAST(date_trunc('day', ts) AS TIMESTAMP) AS sp_start_utc, props AS payload,
        sha256(props) AS payload_hash,
        CAST(date_trunc('hour', ts) AS TIMESTAMP) AS fetched_at_utc FROM events""",
    ),
    "busy": (
        (),
        """SELECT *, sha256(payload) AS payload_hash FROM (SELECT event_id AS landing_id,
        user_id % 7 AS series_key, CAST(date_trunc('month', ts) AS TIMESTAMP) AS sp_start_utc,
        CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS payload,
        CAST(date_trunc('hour', ts) AS TIMESTAMP) AS fetched_at_utc FROM events)""",
    ),
    "hh": (("ev",), _halves("'all'", "event_type <> 'error'")),
    "panel": (("ev",), _halves("event_type", "value >= 5")),
    "user_panel": (("ev",), _halves("user_id", "value >= 5")),
    "spine": (
        (),
        """SELECT unnest(generate_series(CAST(date_trunc('day', min(ts)) AS TIMESTAMP),
        CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL '23 hours 30 minutes',
        INTERVAL '30 minutes')) AS sp_start_utc FROM events""",
    ),
    "long_spine": (
        (),
        """SELECT unnest(generate_series(CAST(min(o_orderdate) AS TIMESTAMP),
        CAST(max(o_orderdate) AS TIMESTAMP) + INTERVAL '23 hours 30 minutes',
        INTERVAL '30 minutes')) AS sp_start_utc FROM orders""",
    ),
    "local_spine": (
        ("long_spine",),
        """SELECT sp_start_utc,
        timezone('Europe/London', timezone('UTC', sp_start_utc)) AS local_ts
        FROM long_spine""",
    ),
    "windows": (
        (),
        """SELECT * FROM (VALUES
        (TIMESTAMP '2024-01-06 20:00:00', TIMESTAMP '2024-01-06 22:00:00'),
        (TIMESTAMP '2024-01-08 07:00:00', TIMESTAMP '2024-01-08 08:00:00'))
        t(window_from_utc, window_to_utc)""",
    ),
    "absent": (
        ("spine", "windows"),
        """SELECT sp_start_utc, 'hh' AS source, 'registered' AS reason,
        DATE '2024-01-31' AS verified_on FROM spine JOIN windows
        ON sp_start_utc >= window_from_utc AND sp_start_utc < window_to_utc""",
    ),
    "facts": (
        ("panel", "absent"),
        f"""SELECT p.*, benchmark - actual AS benchmark_error,
        ({AS_OF} - p.sp_start_utc > INTERVAL '24 hours' AND (revision_count = 1
          OR {AS_OF} - knowable_at_utc > INTERVAL '6 hours')) AS is_matured,
        (actual IS NULL AND {AS_OF} - p.sp_start_utc > INTERVAL '24 hours')
          AS is_permanently_unscoreable,
        benchmark IS NULL AS benchmark_missing,
        (benchmark IS NOT NULL AND benchmark BETWEEN 0 AND 800) AS is_benchmark_plausible,
        (actual IS NOT NULL AND actual BETWEEN 0 AND 800
          AND benchmark IS NOT NULL AND benchmark BETWEEN 0 AND 800) AS is_comparable,
        a.sp_start_utc IS NOT NULL AS is_known_absent_upstream
        FROM panel p LEFT JOIN absent a ON a.sp_start_utc = p.sp_start_utc""",
    ),
    "mix_cents": (
        ("ev",),
        f"""SELECT {_HALF} AS sp_start_utc, event_type,
        CAST(sum(v) * 100 AS BIGINT) AS cents, max(ts) AS knowable_at_utc
        FROM ev GROUP BY 1, 2""",
    ),
    "mix": (
        ("mix_cents",),
        f"""SELECT sp_start_utc, {_FUEL} AS fuel,
        CAST(((cents * 20000 + total) // (2 * total)) * CAST(0.01 AS DECIMAL(3,2))
          AS DECIMAL(5,2)) AS perc, knowable_at_utc,
        ({_FUEL}) IN ('wind','solar','hydro','nuclear','biomass') AS is_low_carbon,
        ({_FUEL}) IN ('gas','coal') AS is_fossil
        FROM (SELECT *, CAST(sum(cents) OVER (PARTITION BY sp_start_utc) AS BIGINT) AS total
              FROM mix_cents) WHERE total <> 0""",
    ),
    "mix_wide": (
        ("mix",),
        """SELECT sp_start_utc,
        max(perc) FILTER (WHERE fuel = 'wind') AS wind_perc,
        max(perc) FILTER (WHERE fuel = 'solar') AS solar_perc,
        max(perc) FILTER (WHERE fuel = 'gas') AS gas_perc,
        max(perc) FILTER (WHERE fuel = 'coal') AS coal_perc,
        max(perc) FILTER (WHERE fuel = 'nuclear') AS nuclear_perc,
        max(perc) FILTER (WHERE fuel = 'imports') AS imports_perc,
        sum(perc) FILTER (WHERE is_low_carbon) AS low_carbon_perc,
        sum(perc) FILTER (WHERE is_fossil) AS fossil_perc,
        sum(perc) AS total_perc, count(*) AS fuels_reported,
        max(knowable_at_utc) AS knowable_at_utc FROM mix GROUP BY 1""",
    ),
    "weather_hour": (
        ("ev",),
        f"""SELECT {_PLACE} AS location_id,
        CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_start_utc,
        CAST(sum(v) AS DECIMAL(14,2)) AS wind_speed_100m_kmh,
        CAST(count(*) AS DECIMAL(14,2)) AS temperature_2m_c,
        max(v) AS shortwave_radiation_wm2, min(v) AS cloud_cover_pct,
        max(ts) AS knowable_at_utc FROM ev GROUP BY 1, 2""",
    ),
    "weather_period": (
        ("weather_hour", "spine"),
        """SELECT s.sp_start_utc, w.* FROM spine s JOIN weather_hour w
        ON w.hour_start_utc = date_trunc('hour', s.sp_start_utc)""",
    ),
    "weather_wide": (
        ("weather_period",),
        "SELECT sp_start_utc, "
        + ", ".join(
            f"max({m}) FILTER (WHERE location_id = '{p}') AS {m}__{p}"
            for m in ("wind_speed_100m_kmh", "temperature_2m_c", "shortwave_radiation_wm2")
            for p in ("scotland_south", "north_sea", "irish_sea", "midlands", "south_coast")
        )
        + " FROM weather_period GROUP BY 1",
    ),
    "vintage": (
        ("ev",),
        f"""SELECT {_HALF} AS sp_start_utc, user_id, max(ts) AS publish_time_utc,
        max(event_id) AS landing_id, CAST(sum(v) AS DECIMAL(14,2)) AS demand_mw
        FROM ev GROUP BY 1, 2""",
    ),
    "origins": (
        (),
        """SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-27',
        INTERVAL '1 day')) AS origin_utc""",
    ),
    "grid96": (
        ("origins",),
        """SELECT origin_utc, CAST(h AS INTEGER) AS horizon,
        origin_utc + h * INTERVAL '30 minutes' AS target_utc
        FROM origins, generate_series(1, 96) g(h)""",
    ),
    "errors": (
        ("panel",),
        """SELECT series_key, 48 AS lag, actual - lag(actual, 48) OVER w AS e FROM panel
        WINDOW w AS (PARTITION BY series_key ORDER BY sp_start_utc)
        UNION ALL SELECT series_key, 96, actual - lag(actual, 96) OVER w FROM panel
        WINDOW w AS (PARTITION BY series_key ORDER BY sp_start_utc)""",
    ),
    "calibration": (
        ("errors", "panel"),
        """SELECT q.series_key, b.band_low, b.band_high, l.quantile_name,
        quantile_cont(CAST(e AS DOUBLE), 0.025) AS o1,
        quantile_cont(CAST(e AS DOUBLE), 0.1) AS o2,
        quantile_cont(CAST(e AS DOUBLE), 0.9) AS o3,
        quantile_cont(CAST(e AS DOUBLE), 0.975) AS o4,
        CASE l.quantile_name WHEN 'q025' THEN o1 WHEN 'q10' THEN o2
          WHEN 'q90' THEN o3 ELSE o4 END AS "offset",
        max(n.rows) - q.lag AS n_samples
        FROM errors q
        JOIN (SELECT series_key, count(*) AS rows FROM panel GROUP BY 1) n
          ON n.series_key = q.series_key AND n.rows > 384
        JOIN (VALUES (1,6,48),(7,24,48),(25,48,48),(49,96,96)) b(band_low, band_high, lag)
          ON b.lag = q.lag,
        (VALUES ('q025'),('q10'),('q90'),('q975')) l(quantile_name)
        GROUP BY q.series_key, b.band_low, b.band_high, l.quantile_name, q.lag""",
    ),
    "matured": (("facts",), "SELECT * FROM facts WHERE is_matured"),
    "matured_errors": (
        ("matured",),
        """SELECT series_key, 48 AS lag, actual - lag(actual, 48) OVER w AS e FROM matured
        WINDOW w AS (PARTITION BY series_key ORDER BY sp_start_utc)
        UNION ALL SELECT series_key, 96, actual - lag(actual, 96) OVER w FROM matured
        WINDOW w AS (PARTITION BY series_key ORDER BY sp_start_utc)""",
    ),
    "matured_calibration": (
        ("matured_errors", "panel"),
        """SELECT q.series_key, b.band_low, b.band_high, l.quantile_name,
        quantile_cont(CAST(e AS DOUBLE), 0.025) AS o1,
        quantile_cont(CAST(e AS DOUBLE), 0.1) AS o2,
        quantile_cont(CAST(e AS DOUBLE), 0.9) AS o3,
        quantile_cont(CAST(e AS DOUBLE), 0.975) AS o4,
        CASE l.quantile_name WHEN 'q025' THEN o1 WHEN 'q10' THEN o2
          WHEN 'q90' THEN o3 ELSE o4 END AS "offset",
        max(n.rows) - q.lag AS n_samples
        FROM matured_errors q
        JOIN (SELECT series_key, count(*) AS rows FROM matured GROUP BY 1) n
          ON n.series_key = q.series_key AND n.rows > 384
        JOIN (VALUES (1,6,48),(7,24,48),(25,48,48),(49,96,96)) b(band_low, band_high, lag)
          ON b.lag = q.lag,
        (VALUES ('q025'),('q10'),('q90'),('q975')) l(quantile_name)
        GROUP BY q.series_key, b.band_low, b.band_high, l.quantile_name, q.lag""",
    ),
    "bands": (
        ("calibration",),
        """SELECT series_key, band_low, band_high,
        CAST(max(CASE WHEN quantile_name = 'q025' THEN "offset" END) AS DECIMAL(18,6)) AS a,
        CAST(max(CASE WHEN quantile_name = 'q10' THEN "offset" END) AS DECIMAL(18,6)) AS b,
        CAST(max(CASE WHEN quantile_name = 'q90' THEN "offset" END) AS DECIMAL(18,6)) AS c,
        CAST(max(CASE WHEN quantile_name = 'q975' THEN "offset" END) AS DECIMAL(18,6)) AS d
        FROM calibration GROUP BY 1, 2, 3""",
    ),
    "targets": (
        ("grid96", "panel"),
        """SELECT series_key, g.* FROM grid96 g, (SELECT DISTINCT series_key FROM panel)""",
    ),
    "seasonal_points": (
        ("targets", "panel"),
        """SELECT t.series_key, t.origin_utc, t.horizon, t.target_utc,
        arg_min(p.actual, k) AS point
        FROM (SELECT *, CASE WHEN horizon <= 48 THEN 1 ELSE 2 END AS k0 FROM targets) t,
        generate_series(0, 13) s(k)
        JOIN panel p ON p.series_key = t.series_key
         AND p.sp_start_utc = t.target_utc - (t.k0 + k) * INTERVAL '1 day'
        GROUP BY 1, 2, 3, 4""",
    ),
    "points": (
        ("seasonal_points", "bands", "targets", "panel"),
        """SELECT s.series_key, 'B1_seasonal_naive_q_v1' AS model_version,
        origin_utc AS run_at_utc, target_utc, horizon, CAST(point AS DECIMAL(8,3)) AS point,
        CAST(point + a AS DECIMAL(8,3)) AS q025, CAST(point + b AS DECIMAL(8,3)) AS q10,
        CAST(point + c AS DECIMAL(8,3)) AS q90, CAST(point + d AS DECIMAL(8,3)) AS q975
        FROM seasonal_points s LEFT JOIN bands b ON b.series_key = s.series_key
         AND s.horizon BETWEEN b.band_low AND b.band_high
        UNION ALL
        SELECT t.series_key, 'B0_persistence_v1', origin_utc, target_utc, horizon,
        CAST(p.actual AS DECIMAL(8,3)), NULL, NULL, NULL, NULL
        FROM targets t ASOF JOIN panel p
          ON p.series_key = t.series_key AND t.origin_utc >= p.sp_start_utc
        UNION ALL
        SELECT t.series_key, 'published_benchmark', origin_utc, target_utc, horizon,
        CAST(p.benchmark AS DECIMAL(8,3)), NULL, NULL, NULL, NULL
        FROM targets t JOIN panel p ON p.series_key = t.series_key
         AND p.sp_start_utc = t.target_utc
        WHERE horizon <= 94 AND p.benchmark IS NOT NULL""",
    ),
    "scale": (
        ("panel",),
        """SELECT a.series_key,
        CAST(sum(abs(a.actual - b.actual)) AS DOUBLE) / count(*) AS scale
        FROM panel a JOIN panel b ON b.series_key = a.series_key
         AND b.sp_start_utc = a.sp_start_utc - INTERVAL '24 hours' GROUP BY 1""",
    ),
    "scores": (
        ("points", "facts", "scale"),
        """SELECT p.*, f.actual, abs(p.point - f.actual) AS abs_error,
        (p.point - f.actual) * (p.point - f.actual) AS sq_error,
        CAST(f.actual AS DOUBLE) - CAST(p.q10 AS DOUBLE) AS d10,
        CAST(f.actual AS DOUBLE) - CAST(p.q90 AS DOUBLE) AS d90,
        CASE WHEN d10 IS NOT NULL THEN
          greatest(CAST(0.1 AS DOUBLE) * d10, CAST(-0.9 AS DOUBLE) * d10) END AS pinball_10,
        CASE WHEN d90 IS NOT NULL THEN greatest(CAST(0.9 AS DOUBLE) * d90,
          CAST('-0.09999999999999998' AS DOUBLE) * d90) END AS pinball_90,
        f.actual BETWEEN p.q10 AND p.q90 AS in_80_interval,
        f.actual BETWEEN p.q025 AND p.q975 AS in_95_interval,
        round(s.scale, 4) AS scale
        FROM points p JOIN facts f ON f.series_key = p.series_key
         AND f.sp_start_utc = p.target_utc
        LEFT JOIN scale s ON s.series_key = p.series_key
        WHERE f.is_matured AND f.actual IS NOT NULL AND NOT f.is_permanently_unscoreable""",
    ),
    "comparable": (
        ("points", "scores"),
        """SELECT s.series_key, s.run_at_utc, s.target_utc FROM scores s
        JOIN (SELECT series_key, run_at_utc, count(DISTINCT model_version) AS issued
              FROM points GROUP BY 1, 2) m
          ON m.series_key = s.series_key AND m.run_at_utc = s.run_at_utc
        GROUP BY s.series_key, s.run_at_utc, s.target_utc
        HAVING count(DISTINCT s.model_version) = max(m.issued)""",
    ),
    "accuracy": (
        ("scores", "comparable"),
        f"""SELECT model_version, {GROUP} AS horizon_group, count(*) AS n,
        round(CAST(sum(abs_error) AS DOUBLE) / count(*), 3) AS mae,
        round(sqrt(CAST(sum(sq_error) AS DOUBLE) / count(*)), 3) AS rmse,
        round(CAST(sum(abs_error) AS DOUBLE) / count(*) / nullif(max(scale), 0), 4) AS mase,
        round(CAST(sum(q90 - q10) AS DOUBLE) / count(q90 - q10), 2) AS interval_width_80,
        round(count(*) FILTER (WHERE in_80_interval) / count(*), 4) AS coverage_80,
        round(count(*) FILTER (WHERE in_95_interval) / count(*), 4) AS coverage_95,
        min(target_utc) AS first_target, max(target_utc) AS last_target
        FROM scores SEMI JOIN comparable USING (series_key, run_at_utc, target_utc)
        GROUP BY 1, 2""",
    ),
    "requests": (
        (),
        """SELECT event_id AS request_id, event_type AS series_key,
        (1 + CAST(floor(value) AS BIGINT) % 16) / 2.0 AS duration_hours,
        CAST(1 + user_id % 48 AS DOUBLE) AS within_hours,
        least(value, 100.0) AS appliance_kwh FROM events""",
    ),
    "ledger": (
        (),
        """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS recorded_at_utc, event_type,
        count(*) AS queries, count(*) AS rows_returned,
        CAST(sum(length(props)) AS BIGINT) AS bytes_estimated FROM events GROUP BY 1, 2""",
    ),
}


def using(names: str, select: str) -> str:
    """The select with the named views, and those they need, in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    body = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    if not order:
        return select
    if select.startswith("WITH "):
        return f"WITH {body},\n{select[5:]}"
    return f"WITH {body}\n{select}"


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with its SQL check, if it has one."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = using(views, sql)
        return fn

    return add
