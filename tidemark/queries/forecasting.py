"""Baselines, backtest, features, calibration and scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.fixtures.adapters import GRID, KEYS, TRAIN_GRID
from tidemark.functions import metrics as MT
from tidemark.functions.scalar import add_seconds, epoch
from tidemark.operators import asof, joins as J, ordering as O
from tidemark.plans import backtest as B
from tidemark.plans import calibrate as CAL
from tidemark.plans import features as FT
from tidemark.plans import quantile as QB
from tidemark.plans import train as TR
from tidemark.queries.common import AS_OF, GROUP, query
from tidemark.session import scratch_dir

FACT = ["series_key", "sp_start_utc"]


def comparable_panel(t):
    return t.facts().select(*FACT, "actual", "benchmark", "is_comparable")


# ---- grid, as-of, baselines -------------------------------------------------
@query(
    "f1_origin_targets",
    "facts origins",
    """SELECT series_key, o.origin_utc, sp_start_utc AS target_utc,
    CAST(epoch(sp_start_utc - o.origin_utc) / 1800 AS INTEGER) AS horizon, actual
    FROM facts JOIN origins o ON sp_start_utc > o.origin_utc
      AND sp_start_utc <= o.origin_utc + INTERVAL '48 hours' WHERE is_comparable""",
)
def f1(t):
    rows = B.backtest_targets(comparable_panel(t), GRID)
    return rows.select(*KEYS, "origin_utc", "target_utc", "horizon", "actual")


@query(
    "f1_training_origins",
    "panel",
    """SELECT series_key, o.origin_utc, sp_start_utc AS target_utc FROM panel
    JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-08',
      TIMESTAMP '2024-01-24' - INTERVAL '12 hours', INTERVAL '12 hours')) AS origin_utc) o
    ON sp_start_utc > o.origin_utc AND sp_start_utc <= o.origin_utc + INTERVAL '48 hours'""",
)
def f1_training(t):
    rows = O.explode_origins(t.panel(), TRAIN_GRID, "sp_start_utc", 1800, 96 * 1800)
    return rows.select(*KEYS, "origin_utc", F.col("sp_start_utc").alias("target_utc"))


@query(
    "j14_f2_asof_last",
    "user_panel",
    """SELECT e.event_id, p.actual AS last_value, p.sp_start_utc AS last_utc
    FROM (SELECT *, ts - INTERVAL '1 hour' AS stamp_utc FROM events) e
    ASOF LEFT JOIN user_panel p ON p.series_key = e.user_id AND e.stamp_utc >= p.sp_start_utc""",
)
def j14(t):
    probes = t.events().select(
        "event_id",
        F.col("user_id").alias("series_key"),
        (F.col("ts") - F.expr("interval 1 hour")).alias("stamp_utc"),
    )
    found = asof.asof_last(t.user_panel(), probes, KEYS, "actual")
    return found.select(
        "event_id", F.col("asof_value").alias("last_value"), F.col("asof_value_utc").alias("last_utc")
    )


def _seasonal(days: int, views="grid96 hh") -> str:
    return f"""SELECT t.origin_utc, t.horizon, t.target_utc, arg_min(h.actual, k) AS pred
    FROM (SELECT *, CAST(greatest(1, ceil(epoch(target_utc - origin_utc) / 86400.0 / {days}))
            AS BIGINT) AS k0 FROM grid96) t, generate_series(0, 13) s(k)
    LEFT JOIN hh h ON h.sp_start_utc = t.target_utc - (t.k0 + k) * INTERVAL '{days} days'
    GROUP BY 1, 2, 3"""


def national_targets(t):
    grid = O.origins(t.spark, GRID)
    return grid.withColumn("known_until_utc", F.col("origin_utc"))


@query("j15_f3_seasonal_naive", "grid96 hh", _seasonal(1))
def j15(t):
    out = asof.seasonal_asof(t.hh(), national_targets(t), [], {"pred": C.SEASON_DAY})
    return out.drop("known_until_utc")


@query("j15_f3_weekly_naive", "grid96 hh", _seasonal(7))
def j15_week(t):
    out = asof.seasonal_asof(t.hh(), national_targets(t), [], {"pred": C.SEASON_WEEK})
    return out.drop("known_until_utc")


_PROFILE = """SELECT p.series_key, 202401 AS origin_month, month(p.sp_start_utc) AS cal_month,
    hour(p.sp_start_utc) * 2 + CASE WHEN minute(p.sp_start_utc) >= 30 THEN 1 ELSE 0 END AS pod,
    round(quantile_cont(CAST(actual AS DOUBLE), 0.5), 3) AS median FROM panel p
    WHERE p.sp_start_utc <= TIMESTAMP '2024-01-07'
      AND p.sp_start_utc > TIMESTAMP '2024-01-07' - INTERVAL '1095 days'
      AND month(p.sp_start_utc) IN (1, 2) GROUP BY 1, 2, 3, 4"""


@query("a18_climatology_profile", "panel", _PROFILE)
def a18(t):
    builds = B.profile_builds(t.spark, GRID, C.EMBARGO_HOURS)
    rows = B.climatology_profile(t.panel(), builds, KEYS)
    return rows.withColumn("median", F.round("median", 3))


_BT = f"""WITH prof AS ({_PROFILE}),
    tg AS (SELECT f.series_key, o.origin_utc, f.sp_start_utc AS target_utc, f.actual, f.benchmark,
      CAST(epoch(f.sp_start_utc - o.origin_utc) / 1800 AS INTEGER) AS horizon,
      o.origin_utc - INTERVAL '24 hours' AS known
      FROM facts f JOIN origins o ON f.sp_start_utc > o.origin_utc
        AND f.sp_start_utc <= o.origin_utc + INTERVAL '48 hours' WHERE f.is_comparable),
    seas AS (SELECT t.series_key, t.origin_utc, t.target_utc, d.days, arg_min(p.actual, k) AS pred
      FROM tg t, (VALUES (1), (7)) d(days), generate_series(0, 13) s(k)
      JOIN panel p ON p.series_key = t.series_key AND p.sp_start_utc = t.target_utc -
        (CAST(greatest(1, ceil(epoch(t.target_utc - t.known) / 86400.0 / d.days)) AS BIGINT) + k)
        * d.days * INTERVAL '1 day'
      GROUP BY 1, 2, 3, 4),
    bt AS (
      SELECT series_key, origin_utc, target_utc, horizon, actual, model,
        CAST(pred AS DECIMAL(18,3)) AS pred FROM (
        SELECT t.*, 'B0_persistence' AS model, p.actual AS pred
          FROM tg t ASOF JOIN panel p ON p.series_key = t.series_key
            AND t.known >= p.sp_start_utc
        UNION ALL SELECT t.*, 'B1_seasonal_naive', s.pred FROM tg t JOIN seas s
          USING (series_key, origin_utc, target_utc) WHERE s.days = 1
        UNION ALL SELECT t.*, 'B2_weekly_naive', s.pred FROM tg t JOIN seas s
          USING (series_key, origin_utc, target_utc) WHERE s.days = 7
        UNION ALL SELECT t.*, 'B3_climatology', CAST(p.median AS DECIMAL(18,3)) FROM tg t
          JOIN prof p ON p.series_key = t.series_key AND p.cal_month = month(t.target_utc)
          AND p.pod = hour(t.target_utc) * 2 +
            CASE WHEN minute(t.target_utc) >= 30 THEN 1 ELSE 0 END
        UNION ALL SELECT t.*, 'published_benchmark', benchmark FROM tg t)
      WHERE pred IS NOT NULL)"""


@query(
    "f4_f5_backtest_points",
    "facts origins panel",
    _BT + """ SELECT series_key, origin_utc, target_utc, horizon,
    CAST(actual AS DECIMAL(18,3)) AS actual, model, pred FROM bt""",
)
def f5(t):
    return B.backtest(comparable_panel(t), GRID, KEYS)


def backtest_summary(t):
    panel = comparable_panel(t)
    scale = O.naive_scale_positional(panel, KEYS)
    return B.summarise(B.backtest(panel, GRID, KEYS), scale, KEYS)


_SUMMARY = f"""SELECT b.series_key, model, horizon_group, n, mae, rmse, bias, mae / s.scale AS mase
    FROM (SELECT series_key, model, {GROUP} AS horizon_group, count(*) AS n,
      CAST(sum(abs(actual - pred)) AS DOUBLE) / count(*) AS mae,
      sqrt(CAST(sum((actual - pred) * (actual - pred)) AS DOUBLE) / count(*)) AS rmse,
      CAST(sum(pred - actual) AS DOUBLE) / count(*) AS bias FROM bt GROUP BY 1, 2, 3) b
    JOIN (SELECT series_key, CAST(sum(abs(d)) AS DOUBLE) / count(d) AS scale FROM (
      SELECT series_key, actual - lag(actual, 48) OVER (PARTITION BY series_key
        ORDER BY sp_start_utc) AS d FROM panel) GROUP BY 1) s USING (series_key)"""


@query("a20_backtest_summary", "facts origins panel", _BT + _SUMMARY)
def a20(t):
    return backtest_summary(t)


@query(
    "f5_strict_backtest",
    "facts origins panel",
    _BT
    + """ SELECT model, count(*) AS n, sum(abs(actual - pred)) AS total_error FROM bt
    SEMI JOIN (SELECT series_key, origin_utc, target_utc FROM bt GROUP BY 1, 2, 3
      HAVING count(*) = 5) USING (series_key, origin_utc, target_utc) GROUP BY 1""",
)
def f5_strict(t):
    rows = B.backtest(comparable_panel(t), GRID, KEYS, strict=True)
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(F.col("actual") - F.col("pred"))).alias("total_error"),
    )


# ---- scales, lags, rolling --------------------------------------------------
@query("a16_naive_scale_time", "scale", "SELECT series_key, scale FROM scale")
def a16(t):
    return t.scale()


@query(
    "a17_naive_scale_positional",
    "hh panel",
    """SELECT series_key, CAST(sum(abs(d)) AS DOUBLE) / count(d) AS scale FROM (
      SELECT series_key, actual - lag(actual, 48) OVER (PARTITION BY series_key
        ORDER BY sp_start_utc) AS d
      FROM (SELECT series_key, sp_start_utc, actual FROM hh
            UNION ALL SELECT series_key, sp_start_utc, actual FROM panel)) GROUP BY 1""",
)
def a17(t):
    both = t.hh().select(*FACT, "actual").unionByName(t.panel().select(*FACT, "actual"))
    return O.naive_scale_positional(both, KEYS)


@query(
    "w13_lag_rows",
    "panel",
    """SELECT series_key, sp_start_utc, actual, lag(actual, 96) OVER (PARTITION BY series_key
      ORDER BY sp_start_utc) AS lagged FROM panel""",
)
def w13(t):
    return O.lag_rows(t.panel().select(*FACT, "actual"), KEYS, "actual", 96)


@query(
    "j8_shift_join",
    "panel",
    """SELECT a.series_key, a.sp_start_utc, a.actual, b.actual AS actual_earlier FROM panel a
    JOIN panel b ON b.series_key = a.series_key
      AND b.sp_start_utc = a.sp_start_utc - INTERVAL '24 hours'""",
)
def j8(t):
    return J.shift_join(t.panel().select(*FACT, "actual"), KEYS, 86400)


@query(
    "w10_rolling_stats",
    "panel",
    """SELECT series_key, sp_start_utc,
    CAST(sum(actual) OVER w AS DOUBLE) / count(actual) OVER w AS mean_24h,
    round(stddev_samp(CAST(actual AS DOUBLE)) OVER w, 6) AS std_24h FROM panel
    WINDOW w AS (PARTITION BY series_key ORDER BY sp_start_utc
      RANGE BETWEEN INTERVAL '23 hours 59 minutes 59 seconds' PRECEDING AND CURRENT ROW)""",
)
def w10(t):
    rows = O.rolling_stats(t.panel().select(*FACT, "actual"), KEYS, "actual", 24)
    return rows.select(*FACT, "mean_24h", F.round("std_24h", 6).alias("std_24h"))


@query(
    "w11_trailing_rows_mean",
    "user_panel origins",
    """SELECT series_key, origin_utc, CAST(sum(actual) AS DOUBLE) / count(actual)
      AS trailing_actual FROM (
      SELECT p.series_key, o.origin_utc, p.actual FROM user_panel p
      JOIN origins o ON p.sp_start_utc <= o.origin_utc
      QUALIFY row_number() OVER (PARTITION BY p.series_key, o.origin_utc
        ORDER BY p.sp_start_utc DESC) <= 48) GROUP BY 1, 2""",
)
def w11(t):
    panel = t.user_panel()
    anchors = (
        panel.select(*KEYS)
        .distinct()
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(GRID.count - 1))))
        .select(
            *KEYS,
            add_seconds(F.lit(GRID.start).cast("timestamp"), F.col("k") * 86400).alias("origin_utc"),
        )
    )
    return asof.trailing_rows_mean(panel, anchors, ["actual"], KEYS)


@query(
    "w12_trailing_mix_mean",
    "mix_wide origins",
    """SELECT origin_utc, CAST(sum(wind_perc) AS DOUBLE) / count(wind_perc) AS mix_wind_mean_24h
    FROM mix_wide JOIN origins ON sp_start_utc <= origin_utc
      AND sp_start_utc > origin_utc - INTERVAL '24 hours' GROUP BY 1""",
)
def w12(t):
    rows = O.explode_origins(t.mix_wide(), GRID, "sp_start_utc", -(86400 - 1), 0)
    return rows.groupBy("origin_utc").agg(MT.mean(F.col("wind_perc")).alias("mix_wind_mean_24h"))


# ---- calibration ------------------------------------------------------------
@query(
    "a19_error_quantiles",
    "calibration",
    """SELECT series_key, band_low, band_high, quantile_name, round("offset", 6) AS "offset",
    n_samples FROM calibration""",
)
def a19(t):
    return t.calibration().withColumn("offset", F.round("offset", 6))


_F18 = f"""SELECT series_key, band_low, band_high, quantile_name, round("offset", 6) AS "offset",
    n_samples, 'second' AS calibration_run_id, 365 AS source_days,
    {AS_OF} AS computed_at_utc FROM matured_calibration"""


def stored_calibrations(t):
    facts = t.facts()
    yesterday = t.as_of - F.expr("interval 1 day")
    old = CAL.calibrate(facts, KEYS, yesterday, "first")
    return old.unionByName(CAL.calibrate(facts, KEYS, t.as_of, "second"))


@query("f18_calibrate", "matured_calibration", _F18)
def f18(t):
    rows = CAL.calibrate(t.facts(), KEYS, t.as_of, "second")
    return rows.withColumn("offset", F.round("offset", 6))


@query("k1_newest_calibration", "matured_calibration", _F18)
def k1(t):
    return CAL.newest_set(stored_calibrations(t)).withColumn("offset", F.round("offset", 6))


@query(
    "f19_load_calibration",
    "matured_calibration",
    """SELECT series_key, band_low, quantile_name, n_samples, CAST(96 AS DOUBLE) AS age_hours,
    true AS is_stale FROM matured_calibration""",
)
def f19(t):
    later = t.as_of + F.expr("interval 4 days")
    rows = CAL.load_calibration(stored_calibrations(t), later)
    return rows.select(
        "series_key", "band_low", "quantile_name", "n_samples", "age_hours", "is_stale"
    )


# ---- metrics ----------------------------------------------------------------
@query(
    "f13_metrics",
    "scores",
    """SELECT series_key, model_version,
    round(CAST(sum(abs(actual - point)) AS DOUBLE) / count(*), 6) AS mae,
    round(sqrt(CAST(sum((actual - point) * (actual - point)) AS DOUBLE) / count(*)), 6) AS rmse,
    round(CAST(sum(point - actual) AS DOUBLE) / count(*), 6) AS bias,
    round(CAST(sum(abs(actual - point)) AS DOUBLE) / count(*) / max(scale), 6) AS mase,
    round(avg(pinball_10), 6) AS pinball_10,
    count(*) FILTER (WHERE actual BETWEEN q10 AND q90)
      / nullif(count(q10), 0) AS coverage_80,
    CAST(sum(q90 - q10) AS DOUBLE) / nullif(count(q90 - q10), 0) AS width_80
    FROM scores GROUP BY 1, 2""",
)
def f13(t):
    scores = t.scores().select("forecast_id", "actual", "scale")
    rows = t.points().join(scores, "forecast_id")
    cov = F.sum(F.when(F.col("actual").between(F.col("q10"), F.col("q90")), 1).otherwise(0))
    have = F.nullif(F.count("q10"), F.lit(0))
    return rows.groupBy(*KEYS, "model_version").agg(
        F.round(MT.mae("actual", "point"), 6).alias("mae"),
        F.round(MT.rmse("actual", "point"), 6).alias("rmse"),
        F.round(MT.bias("actual", "point"), 6).alias("bias"),
        F.round(MT.mase("actual", "point", F.col("scale")), 6).alias("mase"),
        F.round(MT.pinball("actual", "q10", 0.10), 6).alias("pinball_10"),
        (cov / have).alias("coverage_80"),
        (F.sum(F.col("q90") - F.col("q10")).cast("double")
         / F.nullif(F.count(F.col("q90") - F.col("q10")), F.lit(0))).alias("width_80"),
    )


# ---- features ---------------------------------------------------------------
def dataset(t, grid=TRAIN_GRID):
    intensity = t.facts().withColumn("knowable_is_reconstructed", F.col("revision_count") > 1)
    intensity = intensity.select(*FACT, "actual", "knowable_at_utc", "knowable_is_reconstructed")
    return FT.build_dataset(grid, intensity, t.stored_mix(), t.stored_weather(), KEYS)


_ISSUE_VIEWS = """WITH org AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-08',
      TIMESTAMP '2024-01-24' - INTERVAL '12 hours', INTERVAL '12 hours')) AS origin_utc),
    seen AS (SELECT p.series_key, o.origin_utc, p.sp_start_utc, p.actual FROM panel p
      JOIN org o ON p.sp_start_utc <= o.origin_utc
       AND (CASE WHEN p.revision_count > 1 THEN p.sp_start_utc + INTERVAL '24 hours'
            ELSE p.knowable_at_utc END) <= o.origin_utc - INTERVAL '24 hours'),
    iss AS (SELECT series_key, origin_utc, """ + ", ".join(
    f"""CAST(arg_max(actual, sp_start_utc) FILTER (WHERE sp_start_utc <=
      origin_utc - INTERVAL '{h} hours') AS DOUBLE) AS intensity_lag_{h}h"""
    for h in C.LAG_HOURS
) + ", " + ", ".join(
    f"""CAST(sum(actual) FILTER (WHERE sp_start_utc > origin_utc - INTERVAL '{h} hours')
      AS DOUBLE) / nullif(count(actual) FILTER (WHERE sp_start_utc > origin_utc
      - INTERVAL '{h} hours'), 0) AS intensity_mean_{h}h,
    round(stddev_samp(CAST(actual AS DOUBLE)) FILTER (WHERE sp_start_utc > origin_utc
      - INTERVAL '{h} hours'), 6) AS intensity_std_{h}h"""
    for h in C.ROLLING_HOURS
) + " FROM seen GROUP BY 1, 2)"


@query(
    "f8_issue_features",
    "panel",
    _ISSUE_VIEWS + " SELECT * FROM iss",
)
def f8_issue(t):
    intensity = t.facts().withColumn("knowable_is_reconstructed", F.col("revision_count") > 1)
    issued = (
        O.explode_origins(t.panel(), TRAIN_GRID, "sp_start_utc", 1800, 96 * 1800)
        .select(*KEYS, "origin_utc")
        .distinct()
    )
    rows = FT.issue_features(intensity, issued, TRAIN_GRID, KEYS, -86400)
    for h in C.ROLLING_HOURS:
        rows = rows.withColumn(f"intensity_std_{h}h", F.round(f"intensity_std_{h}h", 6))
    return rows


_WINDS = ("scotland_south", "north_sea", "irish_sea", "midlands", "south_coast")
_WCOLS = [
    f"{m}__{p}"
    for m in ("wind_speed_100m_kmh", "temperature_2m_c", "shortwave_radiation_wm2")
    for p in _WINDS
]
_TRAIL = ", ".join(
    f"CAST(sum(wind_speed_100m_kmh__{p}) AS DOUBLE) / count(wind_speed_100m_kmh__{p}) AS t_{p}"
    for p in _WINDS
)
_DATASET = (
    _ISSUE_VIEWS
    + f""", mixf AS (SELECT origin_utc,
      CAST(arg_max(wind_perc, sp_start_utc) AS DOUBLE) AS mix_wind_perc_at_issue,
      CAST(arg_max(solar_perc, sp_start_utc) AS DOUBLE) AS mix_solar_perc_at_issue,
      CAST(arg_max(low_carbon_perc, sp_start_utc) AS DOUBLE) AS mix_low_carbon_perc_at_issue
      FROM (SELECT o.origin_utc, m.* FROM org o ASOF JOIN mix_wide m
            ON o.origin_utc >= m.sp_start_utc) GROUP BY 1),
    mixm AS (SELECT origin_utc, CAST(sum(wind_perc) AS DOUBLE) / count(wind_perc)
      AS mix_wind_mean_24h FROM mix_wide JOIN org ON sp_start_utc <= origin_utc
      AND sp_start_utc > origin_utc - INTERVAL '24 hours' GROUP BY 1),
    trail AS (SELECT origin_utc, {_TRAIL} FROM (SELECT o.origin_utc, w.* FROM org o
      JOIN weather_wide w ON w.sp_start_utc <= o.origin_utc
      QUALIFY row_number() OVER (PARTITION BY o.origin_utc ORDER BY w.sp_start_utc DESC) <= 48)
      GROUP BY 1),
    tg AS (SELECT series_key, origin_utc, sp_start_utc AS target_utc,
      CAST(actual AS DOUBLE) AS y, CAST(epoch(sp_start_utc - origin_utc) / 1800 AS INTEGER)
        AS horizon_periods,
      hour(sp_start_utc) * 2 + CASE WHEN minute(sp_start_utc) >= 30 THEN 1 ELSE 0 END AS pod
      FROM panel JOIN org ON sp_start_utc > origin_utc
        AND sp_start_utc <= origin_utc + INTERVAL '48 hours')
    SELECT tg.series_key, tg.origin_utc, target_utc, y, horizon_periods,
    round(sin(2 * pi() * pod / 48), 9) AS sin_period_of_day,
    round(cos(2 * pi() * pod / 48), 9) AS cos_period_of_day,
    round(sin(2 * pi() * dayofyear(target_utc) / 365.25), 9) AS sin_day_of_year,
    round(cos(2 * pi() * dayofyear(target_utc) / 365.25), 9) AS cos_day_of_year,
    isodow(target_utc) - 1 AS day_of_week,
    CASE WHEN isodow(target_utc) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    {", ".join(f"intensity_lag_{h}h" for h in C.LAG_HOURS)},
    {", ".join(f"intensity_mean_{h}h, intensity_std_{h}h" for h in C.ROLLING_HOURS)},
    mix_wind_perc_at_issue, mix_solar_perc_at_issue, mix_low_carbon_perc_at_issue,
    mix_wind_mean_24h, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _WCOLS)},
    {", ".join(f'''round(CAST(wind_speed_100m_kmh__{p} AS DOUBLE) - t_{p}, 6)
      AS ramp_wind_speed_100m_kmh__{p}''' for p in _WINDS)}
    FROM tg JOIN iss USING (series_key, origin_utc)
    LEFT JOIN mixf USING (origin_utc) LEFT JOIN mixm USING (origin_utc)
    LEFT JOIN trail USING (origin_utc)
    LEFT JOIN weather_wide w ON w.sp_start_utc = tg.target_utc"""
)


@query("f8_f9_training_set", "panel mix_wide weather_wide", _DATASET)
def f9(t):
    rows = dataset(t)
    fine = {c: 9 for c in rows.columns if c.startswith(("sin_", "cos_"))}
    fine |= {c: 6 for c in rows.columns if c.startswith(("ramp_", "intensity_std"))}
    return rows.select(*[F.round(c, fine[c]).alias(c) if c in fine else c for c in rows.columns])


@query(
    "j16_lookup_targets",
    "grid96 weather_wide",
    """SELECT origin_utc, horizon, target_utc, wind_speed_100m_kmh__north_sea,
    temperature_2m_c__midlands FROM grid96 g LEFT JOIN weather_wide w
      ON w.sp_start_utc = g.target_utc""",
)
def j16(t):
    wide = t.weather_wide().select(
        "sp_start_utc", "wind_speed_100m_kmh__north_sea", "temperature_2m_c__midlands"
    )
    return J.lookup_targets(O.origins(t.spark, GRID), wide)


@query(
    "j18_targets_present",
    "targets panel",
    """SELECT t.* FROM targets t SEMI JOIN panel p ON p.series_key = t.series_key
      AND p.sp_start_utc = t.target_utc""",
)
def j18(t):
    from tidemark.plans.issue import issue_targets

    targets = issue_targets(t.panel(), GRID, KEYS).drop("run_at_utc")
    return J.targets_present(targets, t.panel(), KEYS)


@query(
    "f6_knowability_guard",
    "panel",
    """SELECT series_key, sp_start_utc, knowable_at_utc FROM panel""",
)
def f6(t):
    rows = t.panel().select(*FACT, "knowable_at_utc")
    return FT.knowable_inline(rows, t.as_of)


@query(
    "u2_all_origins",
    "panel",
    """SELECT origin_utc, count(*) AS rows, count(DISTINCT series_key) AS series FROM panel
    JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-08',
      TIMESTAMP '2024-01-24' - INTERVAL '12 hours', INTERVAL '12 hours')) AS origin_utc) o
    ON sp_start_utc > origin_utc AND sp_start_utc <= origin_utc + INTERVAL '48 hours'
    GROUP BY 1""",
)
def u2(t):
    rows = O.explode_origins(t.panel(), TRAIN_GRID, "sp_start_utc", 1800, 96 * 1800)
    return rows.groupBy("origin_utc").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("series_key").alias("series")
    )


# ---- split, learner, intervals ----------------------------------------------
@query(
    "f10_chronological_split",
    "panel",
    """SELECT count(*) AS rows, is_fit, min(horizon) AS first_horizon, min(origin_utc)
      AS first_origin, max(origin_utc) AS last_origin FROM (
      SELECT *, max(rn) OVER (PARTITION BY origin_utc, horizon) <= floor(total * 0.75) AS is_fit
      FROM (SELECT origin_utc, CAST(epoch(sp_start_utc - origin_utc) / 1800 AS INTEGER)
          AS horizon, row_number() OVER (ORDER BY origin_utc, sp_start_utc, series_key) AS rn,
          count(*) OVER () AS total FROM panel
        JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-08',
          TIMESTAMP '2024-01-24' - INTERVAL '12 hours', INTERVAL '12 hours')) AS origin_utc) o
        ON sp_start_utc > origin_utc AND sp_start_utc <= origin_utc + INTERVAL '48 hours'))
    GROUP BY is_fit""",
)
def f10(t):
    rows = O.explode_origins(t.panel(), TRAIN_GRID, "sp_start_utc", 1800, 96 * 1800)
    rows = rows.withColumn(
        "horizon_periods", ((epoch("sp_start_utc") - epoch("origin_utc")) / 1800).cast("int")
    )
    return TR.chronological_split(rows).groupBy("is_fit").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("horizon_periods").alias("first_horizon"),
        F.min("origin_utc").alias("first_origin"),
        F.max("origin_utc").alias("last_origin"),
    )


@query(
    "a21_conformal_width",
    "scores",
    """SELECT round(quantile_cont(greatest(CAST(q10 AS DOUBLE) - CAST(actual AS DOUBLE),
      CAST(actual AS DOUBLE) - CAST(q90 AS DOUBLE)), 0.80), 6) AS widen_q10,
    round(quantile_cont(greatest(CAST(q025 AS DOUBLE) - CAST(actual AS DOUBLE),
      CAST(actual AS DOUBLE) - CAST(q975 AS DOUBLE)), 0.95), 6) AS widen_q025
    FROM scores WHERE q10 IS NOT NULL""",
)
def a21(t):
    widths = TR.conformal_widths(scored_intervals(t))
    return widths.select(*[F.round(c, 6).alias(c) for c in widths.columns])


def scored_intervals(t):
    rows = t.points().where(F.col("q10").isNotNull()).select("forecast_id", *C.QUANTILE_LEVELS)
    rows = rows.join(t.scores().select("forecast_id", "actual"), "forecast_id")
    return rows.select(
        "forecast_id",
        F.col("actual").cast("double").alias("y"),
        *[F.col(q).cast("double").alias(q) for q in C.QUANTILE_LEVELS],
    )


@query(
    "a22_interval_report",
    "scores",
    """SELECT series_key, count(*) AS n,
    count(*) FILTER (WHERE actual BETWEEN q10 AND q90) / count(*) AS coverage_80,
    count(*) FILTER (WHERE actual BETWEEN q025 AND q975) / count(*) AS coverage_95,
    round(CAST(sum(q90 - q10) AS DOUBLE) / count(*), 6) AS width_80,
    round(CAST(sum(q975 - q025) AS DOUBLE) / count(*), 6) AS width_95,
    round(avg(pinball_10), 6) AS pinball_10, round(avg(pinball_90), 6) AS pinball_90
    FROM scores WHERE q10 IS NOT NULL GROUP BY 1""",
)
def a22(t):
    rows = scored_intervals(t).withColumn(
        "series_key", F.split("forecast_id", "[|]").getItem(0)
    )
    out = TR.interval_report(rows, KEYS)
    rounded = ("width_80", "width_95", "pinball_10", "pinball_90")
    return out.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in out.columns])


@query(
    "n35_conformal_intervals",
    "scores",
    """SELECT series_key, run_at_utc, target_utc, round(CAST(q025 AS DOUBLE) - b, 4) AS q025,
    round(CAST(q10 AS DOUBLE) - a, 4) AS q10, round(CAST(q90 AS DOUBLE) + a, 4) AS q90,
    round(CAST(q975 AS DOUBLE) + b, 4) AS q975 FROM (
      SELECT *, quantile_cont(greatest(CAST(q10 AS DOUBLE) - CAST(actual AS DOUBLE),
        CAST(actual AS DOUBLE) - CAST(q90 AS DOUBLE)), 0.80) OVER () AS w80,
      greatest(w80, -1e9) AS a,
      quantile_cont(greatest(CAST(q025 AS DOUBLE) - CAST(actual AS DOUBLE),
        CAST(actual AS DOUBLE) - CAST(q975 AS DOUBLE)), 0.95) OVER () AS b
      FROM scores WHERE q10 IS NOT NULL)""",
)
def n35(t):
    rows = scored_intervals(t)
    wide = TR.widened(rows, TR.conformal_widths(rows).first().asDict())
    parts = F.split("forecast_id", "[|]")
    return wide.select(
        parts.getItem(0).alias("series_key"),
        parts.getItem(2).cast("timestamp").alias("run_at_utc"),
        parts.getItem(3).cast("timestamp").alias("target_utc"),
        *[F.round(q, 4).alias(q) for q in C.QUANTILE_LEVELS],
    )


def trained(t):
    """A small boosted model of the panel, and the feature rows it has not seen."""
    rows = t.stored("features", lambda: dataset(t))
    cut = F.lit("2024-01-20").cast("timestamp")
    model = TR.train(
        rows.where(F.col("origin_utc") < cut), FT.feature_columns(rows),
        max_iter=8, max_depth=4, min_leaf=5, learning_rate=0.2,
    )
    return model, rows.where(F.col("origin_utc") >= cut)


@query("f11_f12_f16_boosted_intervals")
def f16(t):
    """Register rows of the boosted model on the issue times after its training."""
    model, held = trained(t)
    return TR.issue_model(model, held.withColumn("run_at_utc", F.col("origin_utc")), KEYS)


_GRADIENTS = """WITH r AS (SELECT CAST(actual AS DOUBLE) AS y, CAST(benchmark AS DOUBLE) AS b,
      CAST(hour(sp_start_utc) * 2 + minute(sp_start_utc) // 30 AS INTEGER) AS slot,
      CAST(isodow(sp_start_utc) AS INTEGER) AS dow FROM panel
      WHERE actual IS NOT NULL AND benchmark IS NOT NULL),
    e AS (SELECT level, slot, dow, q - CAST(y <= (CASE level WHEN 0 THEN b ELSE b * 1.5 END) AS INTEGER) AS g
      FROM r, (VALUES (0, CAST(0.1 AS DOUBLE)), (1, CAST(0.9 AS DOUBLE))) l(level, q)),
    h AS (SELECT level, 0 AS node, feature, bin, count(*) AS n, sum(g) AS gradient FROM (
      SELECT level, 0 AS feature, slot AS bin, g FROM e UNION ALL SELECT level, 1, dow, g FROM e)
      GROUP BY ALL)"""


def gradients(t):
    """The first histogram of two levels over the panel, predicted by its benchmark and by half more."""
    b, at = F.col("benchmark").cast("double"), "sp_start_utc"
    rows = t.panel().where("actual is not null and benchmark is not null").select(
        F.col("actual").cast("double").alias("y"),
        F.array(b, b * 1.5).alias("preds"),
        F.array(F.lit(0), F.lit(0)).alias("nodes"),
        F.array(
            (F.hour(at) * 2 + F.floor(F.minute(at) / 30)).cast("int"), (F.weekday(at) + 1).cast("int")
        ).alias("bins"),
    )
    return QB.gradient_histogram(rows, {"q10": 0.1, "q90": 0.9})


@query(
    "f12_gradient_histogram",
    "panel",
    f"{_GRADIENTS} SELECT level, node, feature, bin, n, round(gradient, 6) AS gradient FROM h",
)
def f12_histogram(t):
    return gradients(t).withColumn("gradient", F.round("gradient", 6))


@query(
    "f12_best_splits",
    "panel",
    f"""{_GRADIENTS}, c AS (SELECT *, sum(n) OVER up AS nl, sum(gradient) OVER up AS gl,
        sum(n) OVER (PARTITION BY level, feature) AS nt,
        sum(gradient) OVER (PARTITION BY level, feature) AS gt FROM h
      WINDOW up AS (PARTITION BY level, feature ORDER BY bin)),
    s AS (SELECT level, node, feature, bin,
      round(gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt, 6) AS gain
      FROM c WHERE nl >= 5 AND nt - nl >= 5)
    SELECT level, node, feature, bin, round(gain, 4) AS gain FROM s WHERE gain > 0
    QUALIFY row_number() OVER (PARTITION BY level, node ORDER BY gain DESC, feature, bin) = 1""",
)
def f12_splits(t):
    return QB.best_splits(gradients(t), 5).withColumn("gain", F.round("gain", 4))


@query("f12_quantile_boosting")
def f12_quantiles(t):
    """Pinball loss and coverage on unseen issue times, of boosted quantiles and of residual bands."""
    bands, held = trained(t)
    rows = t.stored("features", lambda: dataset(t)).where(
        F.col("origin_utc") < F.lit("2024-01-20").cast("timestamp")
    )
    model = QB.fit_quantiles(rows, FT.feature_columns(rows), rounds=4, bins=8, min_leaf=5, rate=0.4)
    named = lambda df, name: TR.interval_report(df.where("y is not null")).withColumn("method", F.lit(name))
    return named(model.predict(held), "boosted_quantiles").unionByName(
        named(bands.forecast(held), "residual_bands")
    )


@query("s15_model_artefact")
def s15(t):
    """The model stored and read back, and its holdout accuracy from the stored copy."""
    path = scratch_dir(t.spark, "model")
    model, held = trained(t)
    scale = F.lit(1.0)
    TR.save_model(
        t.spark, path, model, {"model_version": "G2_gbt_v1", "uses_benchmark": False},
        TR.holdout_summary(model.forecast(held), scale),
    )
    again, _ = TR.load_model(t.spark, path)
    return TR.holdout_summary(again.forecast(held), scale)
