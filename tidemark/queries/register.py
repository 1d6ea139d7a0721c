"""Register, scoring, seals, planner, status and published payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.fixtures.adapters import AS_OF as AS_OF_TIME, KEYS
from tidemark.operators import joins as J
from tidemark.plans import issue as I
from tidemark.plans import planner as P
from tidemark.plans import register as R
from tidemark.plans import registry as G
from tidemark.plans import status as ST
from tidemark.queries.common import AS_OF, GROUP, query
from tidemark.session import scratch_dir, written
from tidemark.sources import payloads, runlog

_ID = """series_key || '|' || model_version || '|' || strftime(run_at_utc, '%Y-%m-%d %H:%M:%S')
    || '|' || strftime(target_utc, '%Y-%m-%d %H:%M:%S')"""
CHAMPION = "model_version = 'B1_seasonal_naive_q_v1'"


# ---- issue ------------------------------------------------------------------
@query(
    "f14_f15_u3_issued_points",
    "points",
    f"""SELECT {_ID} AS forecast_id, series_key, model_version, run_at_utc, target_utc, horizon,
    point, q025, q10, q90, q975 FROM points""",
)
def f14(t):
    return t.issued().drop("row_hash", "feature_hash")


@query(
    "u3_issue_report",
    "points",
    """SELECT model_version, count(*) AS n FROM points GROUP BY 1
    UNION ALL SELECT 'G2_gbt_v1', 0""",
)
def u3(t):
    return I.issue_report(t.points(), [I.CHAMPION, I.PERSISTENCE, I.PUBLISHED, I.GBT])


def _text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '' ELSE '\"{c}\":\"' || CAST({c} AS VARCHAR) || '\",' END"


_ROW_HASH = (
    "sha256('{\"horizon\":\"' || horizon || '\",\"model_version\":\"' || model_version || "
    "'\",\"point\":\"' || CAST(point AS VARCHAR) || '\",' || "
    + " || ".join(_text(c) for c in ("q025", "q10", "q90", "q975"))
    + " || '\"run_at\":\"' || strftime(run_at_utc, '%Y-%m-%d %H:%M:%S') || '\",\"series_key\":\"'"
    " || series_key || '\",\"target\":\"' || strftime(target_utc, '%Y-%m-%d %H:%M:%S') || '\"}')"
)


@query(
    "f17_row_hash",
    "points",
    f"SELECT {_ID} AS forecast_id, {_ROW_HASH} AS row_hash FROM points",
)
def f17(t):
    return t.points().select("forecast_id", "row_hash")


@query(
    "f26_register_contract",
    "points",
    """SELECT violation, count(*) AS n FROM (
      SELECT CASE WHEN NOT target_utc > run_at_utc THEN 'not_forward'
        WHEN horizon NOT BETWEEN 1 AND 96 THEN 'horizon_out_of_range'
        WHEN NOT (q025 <= q10 AND q10 <= q90 AND q90 <= q975) THEN 'quantiles_not_ordered'
        WHEN count(*) OVER (PARTITION BY series_key, model_version, run_at_utc, target_utc) > 1
        THEN 'grain_not_unique' END AS violation FROM (
        SELECT series_key, model_version, run_at_utc, horizon, q025, q10, q90, q975,
          CASE WHEN point < 2 THEN run_at_utc ELSE target_utc END AS target_utc FROM points))
    GROUP BY 1""",
)
def f26(t):
    """Points with a value below 2 are bent to target their own issue time."""
    bent = t.points().withColumn(
        "target_utc", F.when(F.col("point") < 2, F.col("run_at_utc")).otherwise(F.col("target_utc"))
    )
    rows = R.validate_register(bent, [*KEYS, *R.GRAIN])
    return rows.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


# ---- score and accuracy -----------------------------------------------------
@query(
    "f20_scores",
    "scores",
    f"""SELECT {_ID} AS forecast_id, actual, abs_error, sq_error, round(pinball_10, 6)
    AS pinball_10, round(pinball_90, 6) AS pinball_90, in_80_interval, in_95_interval, scale
    FROM scores""",
)
def f20(t):
    rows = t.scored()
    for c in ("pinball_10", "pinball_90"):
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


@query(
    "a29_pending_scores",
    "scores",
    "SELECT model_version, count(*) AS pending FROM scores GROUP BY 1",
)
def a29(t):
    rows = R.pending_scores(t.points(), t.facts())
    return rows.groupBy("model_version").agg(F.count(F.lit(1)).alias("pending"))


@query(
    "j6_unscored",
    "points scores",
    f"""SELECT {_ID} AS forecast_id FROM points
    ANTI JOIN scores USING (series_key, model_version, run_at_utc, target_utc)""",
)
def j6(t):
    return J.unscored(t.points(), t.scores()).select("forecast_id")


@query(
    "a5_comparable_targets",
    "comparable",
    "SELECT series_key, run_at_utc, target_utc FROM comparable",
)
def a5(t):
    points = t.points()
    return R.comparable_targets(points, J.scored_rows(points, t.scores()))


@query("a4_j10_live_accuracy", "accuracy", "SELECT * FROM accuracy")
def a4(t):
    return R.live_accuracy(t.points(), t.scores())


@query(
    "f21_w7_leaderboard",
    "accuracy",
    """SELECT horizon_group, model_version, n, mae, mase,
    rank() OVER (PARTITION BY horizon_group ORDER BY mae) AS position FROM accuracy""",
)
def f21(t):
    return R.leaderboard(R.live_accuracy(t.points(), t.scores()))


@query(
    "f21_p16_accuracy_report",
    "accuracy",
    """SELECT model_version, horizon_group, n, mae, n >= 200 AS publishable,
    CAST(sum(n) OVER () AS BIGINT) AS total_scored_points, bool_or(n >= 200) OVER () AS any_publishable
    FROM accuracy WHERE model_version = 'B0_persistence_v1'""",
)
def p16(t):
    rows = R.live_accuracy(t.points(), t.scores()).select(
        "model_version", "horizon_group", "n", "mae"
    )
    return R.accuracy_report(rows, "B0_persistence_v1")


@query(
    "a23_register_size",
    "points",
    """SELECT count(*) AS forecasts, count(DISTINCT model_version) AS models,
    min(run_at_utc) AS first_issued, max(run_at_utc) AS last_issued FROM points""",
)
def a23(t):
    return R.register_size(t.points())


@query(
    "a24_latest_runs",
    "points",
    f"""SELECT series_key, model_version, max(run_at_utc) AS run_at_utc FROM points
    WHERE {CHAMPION} GROUP BY 1, 2""",
)
def a24(t):
    return R.latest_runs(t.points(), t.registry())


@query(
    "j17_champion_points",
    "points",
    f"""SELECT series_key, run_at_utc, target_utc, point FROM points WHERE {CHAMPION}""",
)
def j17(t):
    return J.champion_points(t.points(), t.registry()).select(
        "series_key", "run_at_utc", "target_utc", "point"
    )


# The promotions of the check; the second evaluation promotes nobody.
PROMOTED = "2024-01-18 12:00:00"
EVENTS = (
    ("p1", "2024-01-01 00:00:00", None, "B1_seasonal_naive_q_v1", "promoted"),
    ("p2", "2024-01-12 00:00:00", "B1_seasonal_naive_q_v1", "published_benchmark", "not_promoted"),
    ("p3", PROMOTED, "B1_seasonal_naive_q_v1", "B0_persistence_v1", "promoted"),
)


def promotion_events(t):
    rows = t.spark.createDataFrame(EVENTS, "promotion_id string, at string, champion_version string, "
                                   "challenger_version string, outcome string")  # fmt: skip
    return rows.withColumn("decided_at_utc", F.col("at").cast("timestamp")).drop("at")


@query(
    "j17_served_points",
    "points",
    f"""SELECT series_key, run_at_utc, target_utc, model_version, point FROM points
    WHERE model_version = CASE WHEN run_at_utc < TIMESTAMP '{PROMOTED}'
      THEN 'B1_seasonal_naive_q_v1' ELSE 'B0_persistence_v1' END""",
)
def j17_served(t):
    """Forecasts as they were served; the champion changes in mid-history."""
    return G.served_points(t.points(), promotion_events(t)).select(
        "series_key", "run_at_utc", "target_utc", "model_version", "point"
    )


@query(
    "a24_latest_promoted",
    "points",
    """SELECT series_key, model_version, max(run_at_utc) AS run_at_utc FROM points
    WHERE model_version = 'B0_persistence_v1' GROUP BY 1, 2""",
)
def a24_promoted(t):
    """The latest run of the champion of the day, from stored promotions."""
    models = t.points().groupBy("model_version").agg(F.min("run_at_utc").alias("created_at_utc"))
    return R.latest_runs(t.points(), G.roles(models, promotion_events(t), t.as_of))


_LATEST = f"""(SELECT * FROM points WHERE {CHAMPION}
    QUALIFY run_at_utc = max(run_at_utc) OVER (PARTITION BY series_key, model_version))"""


@query(
    "k3_first_horizons",
    "points",
    f"""SELECT series_key, run_at_utc, horizon, target_utc, point, q10, q90 FROM {_LATEST}
    QUALIFY row_number() OVER (PARTITION BY series_key, run_at_utc ORDER BY horizon) <= 24""",
)
def k3(t):
    rows = R.current_forecast(t.points(), t.registry(), first=24)
    return rows.select("series_key", "run_at_utc", "horizon", "target_utc", "point", "q10", "q90")


@query(
    "k2_recent_runs",
    "ledger",
    """SELECT event_type AS source, recorded_at_utc AS started_at_utc, queries AS rows_written
    FROM ledger ORDER BY recorded_at_utc DESC, event_type DESC LIMIT 10""",
)
def k2(t):
    runs = t.run_log()
    return ST.recent_runs(runs, 10).select("source", "started_at_utc", "rows_written")


# ---- seals ------------------------------------------------------------------
_DAY_SEAL = """SELECT CAST(fetched_at_utc AS DATE) AS period_month, count(*) AS row_count,
    sha256(string_agg(payload_hash, '' ORDER BY id)) AS seal_hash, 'flat' AS algorithm
    FROM (SELECT *, lpad(CAST(landing_id AS VARCHAR), 12, '0') AS id FROM landing) GROUP BY 1"""


def sealed_rows(t):
    """Landing rows in the place of register rows, sealed by day."""
    return t.landing().select(
        F.lpad(F.col("landing_id").cast("string"), 12, "0").alias("forecast_id"),
        F.col("payload_hash").alias("row_hash"),
        F.col("fetched_at_utc").alias("run_at_utc"),
    )


@query("a25_period_seals", "landing", _DAY_SEAL)
def a25(t):
    return R.month_seals(sealed_rows(t), F.date_trunc("day", "run_at_utc"), "flat")


def _tree_sql(rows: str, period: str) -> str:
    """Seals of rows (id, run_at, h), by parts, days and periods."""
    return f"""SELECT period_month, CAST(sum(n) AS BIGINT) AS row_count,
      sha256(string_agg(h, '' ORDER BY day)) AS seal_hash, 'tree' AS algorithm FROM (
        SELECT period_month, day, sum(n) AS n, sha256(string_agg(h, '' ORDER BY part)) AS h FROM (
          SELECT CAST(date_trunc('{period}', run_at) AS DATE) AS period_month,
            CAST(run_at AS DATE) AS day, substring(sha256(id), 1, 4) AS part, count(*) AS n,
            sha256(string_agg(h, '' ORDER BY id)) AS h FROM ({rows}) GROUP BY 1, 2, 3)
        GROUP BY 1, 2) GROUP BY 1"""


_LANDED = """SELECT lpad(CAST(landing_id AS VARCHAR), 12, '0') AS id, fetched_at_utc AS run_at,
      payload_hash AS h FROM landing"""


@query("a25_tree_seals", "landing", _tree_sql(_LANDED, "day"))
def a25_tree(t):
    return R.month_seals(sealed_rows(t), F.date_trunc("day", "run_at_utc"))


@query(
    "f25_seal_register",
    "points",
    _tree_sql(f"SELECT {_ID} AS id, run_at_utc AS run_at, {_ROW_HASH} AS h FROM points", "month"),
)
def f25(t):
    after = F.lit("2024-02-05").cast("timestamp")
    return R.seal_new_months(t.points(), None, after).drop("sealed_at_utc")


@query(
    "f25_audit_seals",
    "landing",
    """SELECT CAST(fetched_at_utc AS DATE) AS period_month,
      CASE WHEN day(fetched_at_utc) % 2 = 0 THEN 'flat' ELSE 'tree' END AS algorithm,
      count(*) AS expected_count,
      count(*) FILTER (WHERE NOT (day(fetched_at_utc) % 5 = 0 AND landing_id % 7 = 0)) AS observed_count,
      count(*) FILTER (WHERE day(fetched_at_utc) % 5 = 0 AND landing_id % 7 = 0) = 0 AS passed
    FROM landing GROUP BY ALL""",
)
def f25_audit(t):
    """Seals of both kinds, over rows of which some were lost after sealing."""
    rows, day = sealed_rows(t), F.date_trunc("day", "run_at_utc")
    even = F.dayofmonth("period_month") % 2 == 0
    seals = R.month_seals(rows, day, "flat").where(even).unionByName(
        R.month_seals(rows, day, "tree").where(~even)
    )
    lost = (F.dayofmonth("run_at_utc") % 5 == 0) & (F.col("forecast_id").cast("long") % 7 == 0)
    return R.audit_seals(rows.where(~lost), seals, day).drop("expected_hash", "observed_hash")


@query(
    "a25_seal_tree",
    "landing",
    f"""WITH p AS (SELECT CAST(run_at AS DATE) AS period_month, CAST(run_at AS DATE) AS day,
        substring(sha256(id), 1, 4) AS part, count(*) AS row_count, max(id) AS newest_id,
        sha256(string_agg(h, '' ORDER BY id)) AS hash FROM ({_LANDED}) GROUP BY 1, 2, 3),
      d AS (SELECT period_month, day, sum(row_count) AS row_count,
        sha256(string_agg(hash, '' ORDER BY part)) AS hash FROM p GROUP BY 1, 2)
    SELECT period_month, 'part' AS level, day, part, row_count, newest_id, hash FROM p
    UNION ALL SELECT period_month, 'day', day, NULL, CAST(row_count AS BIGINT), NULL, hash FROM d
    UNION ALL SELECT period_month, 'month', NULL, NULL, CAST(sum(row_count) AS BIGINT), NULL,
      sha256(string_agg(hash, '' ORDER BY day)) FROM d GROUP BY 1""",
)
def a25_levels(t):
    """The levels of the day seals; the mark is a sum that SQL elsewhere has not."""
    return R.seal_tree(sealed_rows(t), F.date_trunc("day", "run_at_utc")).drop("mark")


@query(
    "f25_changed_parts",
    "landing",
    """SELECT period_month, day, part, sealed_count, observed_count FROM (
      SELECT CAST(fetched_at_utc AS DATE) AS period_month, CAST(fetched_at_utc AS DATE) AS day,
      substring(sha256(lpad(CAST(landing_id AS VARCHAR), 12, '0')), 1, 4) AS part,
      count(*) AS sealed_count,
      count(*) FILTER (WHERE NOT (day(fetched_at_utc) % 5 = 0 AND landing_id % 7 = 0)) AS observed_count,
      count(*) FILTER (WHERE day(fetched_at_utc) % 3 = 0 AND landing_id % 11 = 0
        AND NOT (day(fetched_at_utc) % 5 = 0 AND landing_id % 7 = 0)) AS rewritten
    FROM landing GROUP BY ALL) WHERE observed_count < sealed_count OR rewritten > 0""",
)
def f25_parts(t):
    """Of sealed rows some were lost and the hashes of others rewritten, counts and ids unmoved."""
    rows, day = sealed_rows(t), F.date_trunc("day", "run_at_utc")
    tree = written(R.seal_tree(rows, day), "tree")
    at, number = F.dayofmonth("run_at_utc"), F.col("forecast_id").cast("long")
    left = rows.where(~((at % 5 == 0) & (number % 7 == 0)))
    forged = F.when((at % 3 == 0) & (number % 11 == 0), F.sha2("row_hash", 256)).otherwise(F.col("row_hash"))
    found = R.changed_parts(left.withColumn("row_hash", forged), tree, day)
    return found.drop("sealed_hash", "observed_hash")


# ---- planner ----------------------------------------------------------------
def champion_now(t):
    return R.current_forecast(t.points(), t.registry())


_PLAN_CORE = f"""WITH run AS {_LATEST},
    wish AS (SELECT request_id, series_key, appliance_kwh, duration_hours, within_hours,
      greatest(1, CAST(floor(duration_hours * 2) AS INTEGER)) AS w,
      CAST(floor(within_hours * 2) AS INTEGER) AS s FROM requests),
    kinds AS (SELECT DISTINCT series_key, w, s FROM wish),
    p AS (SELECT k.w, k.s, r.*, row_number() OVER (PARTITION BY k.series_key, k.w, k.s
        ORDER BY horizon) AS i FROM kinds k JOIN run r ON r.series_key = k.series_key
      QUALIFY i <= k.s),
    c AS (SELECT *, sum(point) OVER a AS cp, count(q10) OVER a AS cn, sum(q10) OVER a AS c10,
        sum(q90) OVER a AS c90, count(*) OVER (PARTITION BY series_key, w, s) AS n FROM p
      WINDOW a AS (PARTITION BY series_key, w, s ORDER BY i)),
    b AS (SELECT x.series_key, x.w, x.s, x.i, x.n, x.horizon, x.target_utc AS start_utc,
        y.target_utc AS end_utc, y.horizon AS last_horizon,
        CAST(y.cp - x.cp + x.point AS DOUBLE) / x.w AS m,
        CAST(y.c10 - x.c10 + x.q10 AS DOUBLE) / x.w AS m10,
        CAST(y.c90 - x.c90 + x.q90 AS DOUBLE) / x.w AS m90,
        extract(hour FROM timezone('Europe/London', timezone('UTC', x.target_utc))) = 3
          AND extract(minute FROM x.target_utc) = 0 AS night
      FROM c x JOIN c y ON y.series_key = x.series_key AND y.w = x.w AND y.s = x.s
        AND y.i = x.i + x.w - 1),
    best AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY series_key, w, s
        ORDER BY m, i) = 1),
    worst AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY series_key, w, s
        ORDER BY m DESC, i) = 1),
    late AS (SELECT * FROM b WHERE night QUALIFY row_number() OVER (
        PARTITION BY series_key, w, s ORDER BY i) = 1),
    whole AS (SELECT series_key, w, s, CAST(sum(point) AS DOUBLE) / count(*) AS m FROM p
      GROUP BY 1, 2, 3)"""


@query(
    "w9_block_extremes",
    "points requests",
    _PLAN_CORE
    + """ SELECT e.series_key, e.w AS window_size, e.s AS search_periods,
    e.start_utc AS best_start_utc, e.end_utc AS best_end_utc, e.m AS best_mean,
    f.start_utc AS worst_start_utc, f.m AS worst_mean, o.m AS now_mean, a.m AS average_mean
    FROM best e JOIN worst f USING (series_key, w, s) JOIN b o ON o.series_key = e.series_key
      AND o.w = e.w AND o.s = e.s AND o.i = 1 JOIN whole a ON a.series_key = e.series_key
      AND a.w = e.w AND a.s = e.s""",
)
def w9(t):
    wanted = t.requests().select(
        *KEYS,
        (F.col("duration_hours") * 2).cast("int").alias("window_size"),
        (F.col("within_hours") * 2).cast("int").alias("search_periods"),
    )
    return P.plan_blocks(champion_now(t), wanted.distinct(), KEYS).select(
        *KEYS, "window_size", "search_periods", "best_start_utc", "best_end_utc", "best_mean",
        "worst_start_utc", "worst_mean", "now_mean", "average_mean",
    )


@query(
    "k4_overnight_block",
    "points requests",
    _PLAN_CORE
    + """ SELECT k.series_key, k.w AS window_size, k.s AS search_periods,
    l.start_utc AS overnight_start_utc, l.end_utc AS overnight_end_utc, l.m AS overnight_mean
    FROM best k LEFT JOIN late l USING (series_key, w, s)""",
)
def k4(t):
    wanted = t.requests().select(
        *KEYS,
        (F.col("duration_hours") * 2).cast("int").alias("window_size"),
        (F.col("within_hours") * 2).cast("int").alias("search_periods"),
    )
    return P.plan_blocks(champion_now(t), wanted.distinct(), KEYS).select(
        *KEYS, "window_size", "search_periods", "overnight_start_utc", "overnight_end_utc",
        "overnight_mean",
    )


_PLAN = (
    _PLAN_CORE
    + """ SELECT r.request_id, r.series_key, e.start_utc AS best_start_utc,
    e.horizon AS min_horizon, e.last_horizon AS max_horizon,
    CASE WHEN e.horizon <= 6 THEN 'H1' WHEN e.horizon <= 24 THEN 'H2'
      WHEN e.horizon <= 48 THEN 'H3' WHEN e.horizon IS NOT NULL THEN 'H4' END AS horizon_group,
    round(e.m, 9) AS best_mean, round(o.m - e.m, 9) AS now_saving,
    round((o.m - e.m) * appliance_kwh, 9) AS now_saved_g,
    round(o.m10 - e.m90, 9) AS now_saving_low, round(o.m90 - e.m10, 9) AS now_saving_high,
    o.m10 - e.m90 < 0 AS now_could_be_worse, round(a.m - e.m, 9) AS average_saving,
    round(l.m - e.m, 9) AS overnight_saving, round(f.m - e.m, 9) AS upper_bound_saving,
    CASE WHEN e.m IS NULL THEN 'not enough forecast periods' END AS detail
    FROM wish r LEFT JOIN best e USING (series_key, w, s)
    LEFT JOIN worst f USING (series_key, w, s)
    LEFT JOIN b o ON o.series_key = r.series_key AND o.w = r.w AND o.s = r.s AND o.i = 1
    LEFT JOIN whole a ON a.series_key = r.series_key AND a.w = r.w AND a.s = r.s
    LEFT JOIN late l ON l.series_key = r.series_key AND l.w = r.w AND l.s = r.s"""
)


def plan_exact(t):
    return P.plan(champion_now(t), t.requests(), digits=9)


@query("f22_plan", "points requests", _PLAN)
def f22(t):
    return plan_exact(t).select(
        "request_id", *KEYS, "best_start_utc", "min_horizon", "max_horizon", "horizon_group",
        "best_mean", "now_saving", "now_saved_g", "now_saving_low", "now_saving_high",
        "now_could_be_worse", "average_saving", "overnight_saving", "upper_bound_saving",
        "detail",
    )


_ASKED = """SELECT event_id, value / 20 AS duration_hours, user_id % 60 AS within_hours,
      value AS appliance_kwh FROM events"""


@query(
    "f22_request_contract",
    "",
    f"""SELECT event_id AS request_id, CASE
      WHEN duration_hours NOT BETWEEN 0.5 AND 8 THEN 'duration_hours_out_of_range'
      WHEN within_hours NOT BETWEEN 1 AND 48 THEN 'within_hours_out_of_range'
      WHEN appliance_kwh NOT BETWEEN 0.01 AND 100 THEN 'appliance_kwh_out_of_range'
      END AS violation FROM ({_ASKED})""",
)
def f22_contract(t):
    """Requests of any numbers; the check names the first that is out of range."""
    from tidemark.plans.planner import request_violation

    asked = t.events().select(
        F.col("event_id").alias("request_id"),
        (F.col("value") / 20).alias("duration_hours"),
        (F.col("user_id") % 60).alias("within_hours"),
        F.col("value").alias("appliance_kwh"),
    )
    return asked.select("request_id", request_violation().alias("violation"))


_RANKED = f"""(SELECT series_key, model_version, {GROUP} AS horizon_group, run_at_utc,
      target_utc, point, actual,
      row_number() OVER (PARTITION BY series_key, model_version, {GROUP}, run_at_utc
        ORDER BY point, target_utc) AS forecast_rank,
      percent_rank() OVER (PARTITION BY series_key, model_version, {GROUP}, run_at_utc
        ORDER BY actual) AS actual_pct,
      count(*) OVER (PARTITION BY series_key, model_version, {GROUP}, run_at_utc) AS candidates
      FROM scores)"""
_HITS = f"""SELECT model_version, horizon_group, count(*) AS decisions,
    count(*) FILTER (WHERE actual_pct <= 0.3334) AS hits,
    round(count(*) FILTER (WHERE actual_pct <= 0.3334) / count(*), 3) AS hit_rate
    FROM {_RANKED} WHERE forecast_rank = 1 AND candidates >= 3 GROUP BY 1, 2"""


@query(
    "w8_rank_candidates",
    "scores",
    f"""SELECT series_key, model_version, run_at_utc, target_utc, forecast_rank, actual_pct,
    candidates FROM {_RANKED}""",
)
def w8(t):
    return P.rank_candidates(J.scored_rows(t.points(), t.scores())).select(
        *KEYS, "model_version", "run_at_utc", "target_utc", "forecast_rank", "actual_pct",
        "candidates",
    )


@query("f23_a28_hit_rate", "scores", _HITS)
def f23(t):
    return P.hit_rate(J.scored_rows(t.points(), t.scores()))


@query(
    "f24_plan_confidence",
    "points requests scores accuracy",
    f"""SELECT p.request_id, p.horizon_group, a.n, a.mae, h.decisions, h.hits, h.hit_rate
    FROM ({_PLAN}) p
    LEFT JOIN accuracy a ON {"a." + CHAMPION} AND a.horizon_group = p.horizon_group
    LEFT JOIN ({_HITS}) h ON {"h." + CHAMPION} AND h.horizon_group = p.horizon_group""",
)
def f24(t):
    points, scores = t.points(), t.scores()
    plans = P.plan(champion_now(t), t.requests())
    out = P.plan_confidence(
        plans, R.live_accuracy(points, scores), P.hit_rate(J.scored_rows(points, scores))
    )
    return out.select("request_id", "horizon_group", "n", "mae", "decisions", "hits", "hit_rate")


# ---- status, ledger, payloads, run log --------------------------------------
@query(
    "a26_usage_state",
    "ledger",
    """SELECT CAST(sum(bytes_estimated) AS BIGINT) AS bytes_estimated,
    CAST(sum(rows_returned) AS BIGINT) AS rows_returned, count(*) AS runs_recorded,
    round(sum(bytes_estimated) / 70000, 4) AS fraction_used,
    CASE WHEN sum(bytes_estimated) / 70000 >= 0.9 THEN 'over'
      WHEN sum(bytes_estimated) / 70000 >= 0.75 THEN 'warn' ELSE 'ok' END AS state
    FROM ledger WHERE recorded_at_utc >= TIMESTAMP '2024-01-12'""",
)
def a26(t):
    return ST.usage_state(t.ledger(), AS_OF_TIME, 12, 70000)


@query(
    "g3_status",
    "spine ledger",
    """SELECT *, CASE WHEN transfer_state <> 'ok' THEN 'transfer ' || transfer_state ELSE '' END
      || CASE WHEN transfer_state <> 'ok' AND runs = 0 THEN '; ' ELSE '' END
      || CASE WHEN runs = 0 THEN 'no runs recorded' ELSE '' END AS warnings
    FROM (SELECT (SELECT count(*) FROM spine) AS periods,
    (SELECT min(sp_start_utc) FROM spine) AS first_period_utc,
    (SELECT max(sp_start_utc) FROM spine) AS last_period_utc,
    (SELECT count(*) FROM ledger WHERE recorded_at_utc < TIMESTAMP '2023-01-01') AS runs,
    round(sum(bytes_estimated) / 700, 4) AS fraction_used,
    CASE WHEN sum(bytes_estimated) / 700 >= 0.9 THEN 'over'
      WHEN sum(bytes_estimated) / 700 >= 0.75 THEN 'warn' ELSE 'ok' END AS transfer_state
    FROM ledger WHERE recorded_at_utc >= TIMESTAMP '2024-01-12')""",
)
def g3(t):
    """A spent budget, and a run log of a year before the data: both warnings are due."""
    runs = t.run_log().where(F.col("started_at_utc") < F.lit("2023-01-01").cast("timestamp"))
    out = ST.status(t.spine(), runs, t.ledger(), AS_OF_TIME, reset_day=12, budget=700)
    return out.withColumn("warnings", F.array_join("warnings", "; "))


def published(t):
    """The seven payloads of one series, and one that fails, in a folder."""
    out = scratch_dir(t.spark, "payloads")

    def broken():
        raise ValueError("this payload cannot be built")

    one = F.col("series_key") == "view"
    accuracy = R.live_accuracy(t.points(), t.scores())
    current = R.current_forecast(t.points().where(one), t.registry())
    wish = [F.lit(v).alias(k) for k, v in C.PLAN_DEFAULTS.items()]
    request = t.spark.range(1).select(
        F.lit("default").alias("request_id"), F.lit("view").alias("series_key"), *wish
    )
    payloads.publish_payloads(
        t.spark,
        {
            "status": lambda: ST.status(t.spine(), t.run_log(), t.ledger(), AS_OF_TIME, reset_day=12, budget=70000),
            "forecast_current": lambda: current,
            "accuracy": lambda: accuracy.select("model_version", "horizon_group", "n", "mae"),
            "leaderboard": lambda: R.leaderboard(accuracy),
            "models": lambda: t.registry(),
            "integrity": lambda: R.register_size(t.points()),
            "plan": lambda: P.plan(current, request),
            "broken": broken,
        },
        out, AS_OF_TIME, params={"plan": C.PLAN_DEFAULTS},
    )
    return out


@query(
    "s14_published_payloads",
    "accuracy",
    """SELECT 'accuracy' AS name, '2024-01-31T00:00:00Z' AS captured_at_utc, model_version,
    horizon_group, n, mae FROM accuracy""",
)
def s14(t):
    schema = (
        "snapshot struct<name:string,captured_at_utc:string>, "
        "payload array<struct<model_version:string,horizon_group:string,n:long,mae:double>>"
    )
    rows = payloads.read_payload(t.spark, published(t), "accuracy", schema)
    return rows.select("snapshot.name", "snapshot.captured_at_utc", "payload.*")


@query(
    "s14_payload_list",
    "accuracy",
    f"""SELECT 'status' AS name, 1 AS n UNION ALL SELECT 'models', 3 UNION ALL SELECT 'integrity', 1
    UNION ALL SELECT 'plan', 1 UNION ALL SELECT 'accuracy', count(*) FROM accuracy
    UNION ALL SELECT 'leaderboard', count(*) FROM accuracy
    UNION ALL SELECT 'forecast_current', count(*) FROM {_LATEST} WHERE series_key = 'view'""",
)
def s14_list(t):
    """The documents that count, and the rows of each."""
    out = published(t)
    paths = [payloads.payload_path(t.spark, out, n) for n in payloads.current(t.spark, out)["files"]]
    docs = t.spark.read.text(paths, wholetext=True)
    return docs.select(
        F.get_json_object("value", "$.snapshot.name").alias("name"),
        F.json_array_length(F.get_json_object("value", "$.payload")).alias("n"),
    )


@query(
    "s16_run_log",
    "panel",
    """SELECT 'landing' AS source, 'success' AS status, (SELECT count(*) FROM events) AS rows_read,
    (SELECT count(*) FROM panel) AS rows_written
    UNION ALL SELECT 'broken', 'failed', 0, 0""",
)
def s16(t):
    path = scratch_dir(t.spark, "runlog")
    store = scratch_dir(t.spark, "panel")

    def work(run):
        rows, seen = run.counted(t.events(), "read")
        rows.groupBy("event_type", F.window("ts", "30 minutes")).count().select(
            "event_type", "count"
        ).write.parquet(store)
        run.rows_read = seen.get["n"]
        run.rows_written = t.spark.read.parquet(store).count()

    def fails(run):
        raise RuntimeError("no such feed")

    runlog.run_logged(t.spark, path, "r1", "landing", "ingest", work)
    try:
        runlog.run_logged(t.spark, path, "r1", "broken", "ingest", fails)
    except RuntimeError:
        pass
    return t.spark.read.schema(runlog.SCHEMA).parquet(path).select(
        "source", "status", "rows_read", "rows_written"
    )


@query(
    "s13_calibration_sink",
    "matured_calibration",
    """SELECT series_key, band_low, quantile_name, n_samples FROM matured_calibration""",
)
def s13(t):
    from tidemark.plans import calibrate as CAL
    from tidemark.sources.tables import append_counted

    path = scratch_dir(t.spark, "calibration")
    rows = CAL.calibrate(t.facts(), KEYS, t.as_of, "stored")
    append_counted(rows, path)
    return t.spark.read.parquet(path).select(
        "series_key", "band_low", "quantile_name", "n_samples"
    )


@query(
    "k5_ordered_accuracy",
    "accuracy",
    f"SELECT model_version, horizon_group, mae, {AS_OF} AS as_of FROM accuracy",
)
def k5(t):
    rows = R.live_accuracy(t.points(), t.scores()).select("model_version", "horizon_group", "mae")
    return rows.withColumn("as_of", t.as_of).orderBy("horizon_group", "mae", "model_version")
