"""The scheduled jobs, bound to one folder of tables: ingest, build, issue, score, seal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import floor_to, instant
from tidemark.operators import audits
from tidemark.operators import versions as V
from tidemark.operators.ordering import TIME, naive_scale_positional, naive_scale_time
from tidemark.operators.versions import current_benchmark
from tidemark.plans import backtest as B
from tidemark.plans import calibrate as CAL
from tidemark.plans import issue as I
from tidemark.plans import marts as M
from tidemark.plans import planner as P
from tidemark.plans import register as R
from tidemark.plans import registry as G
from tidemark.plans import staging as ST
from tidemark.plans import status
from tidemark.sources import feeds, payloads, runlog
from tidemark.sources import tables as S
from tidemark.sources.spine import spine
from tidemark.session import clear_scratch, written
from tidemark.streaming import land

KEYS = ["series_key"]
LEDGER = "recorded_at_utc timestamp, job string, queries long, rows_returned long, bytes_estimated long"
Capture = Callable[[str, datetime, datetime], str | None]
READERS: dict[str, Callable] = {
    "ci_intensity": feeds.read_intensity,
    "ci_genmix": feeds.read_genmix,
    "ci_regional": feeds.read_regional,
    "ex_demand": feeds.read_demand,
    "ex_price": feeds.read_price,
    "om_archive": feeds.read_weather,
    "om_forecast": feeds.read_weather,
    "om_vintage": feeds.read_weather,
}


class RegisterError(RuntimeError):
    """The register holds, or would hold, what it must not."""


class Warehouse:
    """One national series in one folder; every job takes its own ``as_of``."""

    def __init__(self, spark: SparkSession, root: str, spine_start: datetime):
        self.spark, self.root, self.spine_start = spark, root.rstrip("/"), spine_start

    # ---- tables -------------------------------------------------------------
    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def table(self, layer: str, name: str) -> DataFrame | None:
        return S.stored(self.spark, self.path(layer, name))

    def landing(self, source: str, since: Column | None = None) -> DataFrame:
        """The landed rows of a source; with ``since`` only files that reach so far are opened."""
        return land.read_landing(self.spark, self.path("landing", C.SOURCES[source].table), since)

    def spine(self, as_of: datetime) -> DataFrame:
        return spine(self.spark, self.spine_start, as_of)

    def facts(self) -> DataFrame:
        """The stored facts as a one-key panel."""
        return self.table("marts", "fct_intensity_period").withColumn(
            "series_key", F.lit("national")
        )

    # ---- ingest and build ---------------------------------------------------
    def ingest(self, source: str, path: str, fetched_at: datetime, run_id: str, whole=False):
        """Land what a captured response changes; deferred sources are skipped."""
        spec = C.SOURCES[source]
        if spec.deferred:
            return None
        target = self.path("landing", spec.table)

        def work(run: runlog.Run) -> None:
            batch = READERS[source](self.spark, path, whole=whole).withColumn(
                "fetched_at_utc", instant(fetched_at)
            )
            run.rows_read = batch.count()
            number = land.next_batch_id(self.spark, target)
            run.rows_written = land.land_batch(
                self.spark, target, batch, spec.keys, number, spec.time_column
            )

        return runlog.run_logged(
            self.spark, self.path("landing", "run_log"), run_id, source, "ingest", work,
            now=lambda: fetched_at,
        )

    def _capture(self, source: str, windows, capture: Capture, fetched_at: datetime, run: runlog.Run, whole: bool):
        """Land what was captured for each window, one batch a window; a window without a response is empty."""
        spec = C.SOURCES[source]
        target = self.path("landing", spec.table)
        for start, end in windows:
            path = capture(source, start, end)
            if path is None:  # the spine tells whether something should have been there
                continue
            batch = written(
                READERS[source](self.spark, path, whole=whole).withColumn("fetched_at_utc", instant(fetched_at)),
                "captured",
            )
            run.rows_read += batch.count()
            number = land.next_batch_id(self.spark, target)
            run.rows_written += land.land_batch(self.spark, target, batch, spec.keys, number, spec.time_column)

    def ingest_scheduled(
        self, as_of: datetime, capture: Capture, run_id: str, names=C.SCHEDULED,
        back_days: float = 2, ahead_days: float = 2, whole: bool = False,
    ) -> dict[str, str]:
        """Every planned source as a step of its own; returns what became of each.

        ``capture(source, from, to)`` names the stored response of a window, or
        None. A source that fails keeps the windows that landed before, its run
        is logged as failed, and the others go on.
        """
        outcome: dict[str, str] = {}
        log = self.path("landing", "run_log")
        for name, windows in status.ingest_plan(as_of, names, back_days, ahead_days):
            span = (windows[0][0], windows[-1][1]) if windows else (None, None)
            try:
                run = runlog.run_logged(
                    self.spark, log, run_id, name, "ingest",
                    lambda run, name=name, windows=windows: self._capture(name, windows, capture, as_of, run, whole),
                    span, now=lambda: as_of,
                )
                outcome[name] = f"read {run.rows_read}, written {run.rows_written}"
            except Exception as exc:  # noqa: BLE001 - one source must not stop the others
                outcome[name] = f"failed: {type(exc).__name__}: {str(exc)[:300]}"
        return outcome

    def heal(
        self, as_of: datetime, absent: DataFrame, capture: Capture, run_id: str,
        source: str = "ci_intensity", lookback_days: int = 14, whole: bool = False,
    ) -> dict:
        """Refetch the windows of what is missing; partial while some of it still is."""
        missing = written(self.missing(as_of, absent, source, lookback_days), "missing")
        plan = status.heal_plan(missing, C.SOURCES[source]).orderBy("chunk_from_utc")
        # no more windows than periods in the look-back
        windows = [
            (r["lo"], r["hi"])
            for r in plan.select(
                F.unix_timestamp("chunk_from_utc").alias("lo"), F.unix_timestamp("chunk_to_utc").alias("hi")
            ).collect()
        ]
        windows = [tuple(datetime.fromtimestamp(x, timezone.utc) for x in w) for w in windows]
        found: dict = {"missing": 0, "healed": 0, "is_partial": False}
        if not windows:
            return found

        def work(run: runlog.Run) -> None:
            self._capture(source, windows, capture, as_of, run, whole)
            found.update(status.heal_outcome(missing, self.landing(source)).first().asDict())
            run.partial = found["is_partial"]

        runlog.run_logged(
            self.spark, self.path("landing", "run_log"), run_id, source, "gapfill", work,
            (windows[0][0], windows[-1][1]), now=lambda: as_of,
        )
        return found

    def build(self, as_of: datetime, absent: DataFrame) -> None:
        """T-1, T-2: the marts, rebuilt over their look-back window only."""
        now = instant(as_of)
        self._upsert(
            "fct_intensity_period", "ci_intensity",
            lambda rows: M.fct_intensity_period(ST.stg_intensity(rows), absent, now), now,
        )
        if S.exists(self.spark, self.path("landing", "lnd_ci_genmix")):
            self._upsert("fct_mix_wide", "ci_genmix", lambda rows: M.mix_wide(ST.stg_genmix(rows)), now)
        if S.exists(self.spark, self.path("landing", "lnd_om_vintage")):
            hours = M.fct_weather_hour(ST.stg_weather(self.landing("om_vintage")))
            S.upsert(
                self.spark, self.path("marts", "fct_weather_hour"),
                hours.withColumn("day", F.to_date("hour_start_utc")),
                ["location_id", "hour_start_utc"], "day",
            )

    def _upsert(self, name: str, source: str, made: Callable[[DataFrame], DataFrame], now) -> None:
        """A mart over its look-back window, from the landing files that reach into it."""
        stored, since = self.table("marts", name), None
        if stored is not None:
            since = stored.select(M.incremental_since(stored, now).alias("since")).first()
            since = F.lit(since["since"]).cast("timestamp") if since and since["since"] else None
        rows = made(self.landing(source, since))
        if since is not None:
            rows = rows.where(F.col(TIME) >= since)
        S.upsert(
            self.spark, self.path("marts", name), rows.withColumn("day", F.to_date(TIME)),
            [TIME], "day",
        )

    def missing(
        self, as_of: datetime, absent: DataFrame, source: str = "ci_intensity", lookback_days: int = 14
    ) -> DataFrame:
        """G1: the periods of a source that should have landed by now."""
        if not C.SOURCES[source].gap_checkable:
            raise ValueError(f"{source} has no period of its own for each of the spine's")
        return status.find_gaps(
            self.spine(as_of), self.landing(source), absent, source, instant(as_of), lookback_days
        )

    def gaps(
        self, as_of: datetime, absent: DataFrame, lookback_days: int = 14, source: str = "ci_intensity"
    ) -> DataFrame:
        """The windows of a feed to refetch."""
        return status.heal_plan(self.missing(as_of, absent, source, lookback_days), C.SOURCES[source])

    # ---- forecast, score, seal ----------------------------------------------
    def calibrate(self, as_of: datetime, run_id: str) -> int:
        """Sixteen offsets, or nothing stored."""
        rows = CAL.calibrate(self.facts(), KEYS, instant(as_of), run_id)
        return S.append_counted(rows, self.path("register", "reg_error_quantile"), 16)

    def issue(self, run_at: datetime) -> int:
        """One run of every model into the register."""
        anchor = self.spark.range(1).select(floor_to(instant(run_at)).alias("a")).first()["a"]
        anchor = anchor.replace(tzinfo=run_at.tzinfo)
        known = self.facts().where(F.col("is_matured") & F.col("actual").isNotNull())
        recent = known.where(
            F.col(TIME) >= instant(run_at - timedelta(days=C.WALKBACK_STEPS + 7))
        )
        offset = int((run_at - anchor).total_seconds())
        targets = I.issue_targets(recent, C.Grid.single(anchor), KEYS, offset)
        bands = CAL.calibration_or_compute(
            self.table("register", "reg_error_quantile"), self.facts(), KEYS, instant(run_at)
        )
        champion = I.issue_seasonal(recent, targets, KEYS, bands)
        ahead = self.landing("ci_intensity").withColumn(
            "benchmark", F.get_json_object("payload", "$.intensity.forecast").cast("decimal(8,3)")
        )
        published = current_benchmark(ahead, [TIME], "benchmark", instant(anchor)).withColumn(
            "series_key", F.lit("national")
        )
        covered = targets.join(champion.select(*KEYS, "target_utc"), [*KEYS, "target_utc"], "left_semi")
        rows = I.issued(
            champion,
            I.issue_persistence(recent, covered, KEYS),
            I.issue_published(published, covered, KEYS),
        )
        return self.register(rows)

    def register(self, rows: DataFrame) -> int:
        """Append rows that keep the contract; refuse the run otherwise."""
        grain = [*KEYS, *R.GRAIN]
        rows = written(rows, "issued")  # checked, compared and stored: computed once
        checked = R.validate_register(rows, grain)
        broken = checked.where(F.col("violation").isNotNull()).groupBy("violation").count()
        found = {r["violation"]: r["count"] for r in broken.collect()}  # at most four rows
        if found:
            raise RegisterError(f"rows that break the register's contract: {found}")
        path = self.path("register", "reg_forecast_point")
        month = F.date_format("run_at_utc", "yyyy-MM")
        return S.append_new(
            self.spark, rows.withColumn("issue_month", month), path, grain, ["issue_month"]
        )

    def points(self) -> DataFrame:
        return self.table("register", "reg_forecast_point")

    def score(self, as_of: datetime) -> int:
        """Forecasts whose targets have matured, once each.

        Of forecasts as of scores only the issue months that still hold a
        forecast without a score are read, of any age.
        """
        scale = naive_scale_time(self.facts(), KEYS, instant(as_of))
        points, scores = self.points(), self.table("register", "reg_forecast_score")
        if scores is not None:
            months = written(R.waiting_months(points, scores, self.facts(), KEYS), "months")
            points, scores = (S.within(x, months, "issue_month") for x in (points, scores))
        rows = R.score(points, self.facts(), scale, scores, KEYS, carry=["issue_month"])
        return S.append_counted(
            rows, self.path("register", "reg_forecast_score"), partition_by=["issue_month"]
        )

    def seal(self, as_of: datetime) -> int:
        """seals of months that have closed since, and the tree of each for later audits."""
        stored = self.table("register", "reg_forecast_seal")
        rows = written(R.seal_new_months(self.points(), stored, instant(as_of)), "seals")
        month = F.to_date(F.date_trunc("month", "run_at_utc"))
        mine = self.points().withColumn("period_month", month)
        tree = R.seal_tree(mine.join(rows, "period_month", "left_semi"))
        # the tree first: a seal without one would never get it
        S.append_new(
            self.spark, tree, self.path("register", "reg_seal_tree"),
            ["period_month", "level", "day", "part"],
        )
        return S.append_counted(rows, self.path("register", "reg_forecast_seal"))

    def audit_register(self, as_of: datetime, whole: bool = False) -> None:
        """every outcome is stored before a mismatch fails the job.

        Only parts of sealed months that moved are hashed again, and those that
        differ are stored by name; ``whole`` hashes everything, by ``audit_seals``.
        """
        seals, tree = (self.table("register", n) for n in ("reg_forecast_seal", "reg_seal_tree"))
        if seals is None:
            return
        now = instant(as_of)
        if whole or tree is None:
            rows = R.audit_seals(self.points(), seals).select("period_month", "passed")
        else:
            rows = R.audit_tree(self.points(), tree).select("period_month", "passed")
            parts = R.changed_parts(self.points(), tree).withColumn("checked_at_utc", now)
            S.append_counted(parts, self.path("register", "reg_seal_changes"))
        path = self.path("register", "reg_seal_audit")
        rows.withColumn("checked_at_utc", now).write.mode("append").parquet(path)
        failed = self.spark.read.parquet(path).where((F.col("checked_at_utc") == now) & ~F.col("passed"))
        if not failed.isEmpty():
            raise RegisterError("sealed months no longer match the register")

    def compact(self, source: str) -> int:
        """The batches of a source's landing as one, ids kept; returns how many there were."""
        return land.compact(self.spark, self.path("landing", C.SOURCES[source].table))

    def prune(self, source: str, as_of: datetime, execute: bool = True) -> dict:
        """The retention of one source: the report first, then the day folders that went.

        A source without a retention keeps all. Where the source names a mart,
        that mart must exist and hold every period that goes.
        """
        spec = C.SOURCES[source]
        path = self.path("landing", spec.table)
        if spec.keep_days is None or not S.exists(self.spark, path):
            return {"report": None, "folders": 0, "rows": 0}
        now, time = instant(as_of), spec.time_column
        report = V.retention_report(self.landing(source), time, spec.keep_days, now).first().asDict()
        if not execute:
            return {"report": report, "folders": 0, "rows": 0}
        mart = None
        if spec.required_mart is not None:
            mart = self.table("marts", spec.required_mart)
            if mart is None or mart.isEmpty():
                raise land.RetentionError(f"{spec.required_mart} is absent or empty; nothing is pruned")
        cutoff = now - F.expr(f"interval {spec.keep_days} days")
        keys = [c for c in spec.keys if mart is None or c in mart.columns]
        went = land.prune_days(self.spark, path, cutoff, now, mart, keys)
        total = went.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r")).first()
        return {"report": report, "folders": total["n"], "rows": total["r"]}

    def finish(self) -> int:
        """Delete what the jobs so far left in scratch folders; results lie elsewhere."""
        return clear_scratch(self.spark)

    # ---- reports ------------------------------------------------------------
    def accuracy(self) -> DataFrame:
        scores = self.table("register", "reg_forecast_score")
        if scores is None:
            scores = self.spark.createDataFrame([], R.SCORE)
        return R.live_accuracy(self.points(), scores.drop("issue_month"), KEYS)

    def publish(self, out: str, as_of: datetime, commit: str) -> dict[str, str]:
        """The seven payloads a page reads; the status comes first."""
        return payloads.publish_payloads(
            self.spark,
            {
                "status": lambda: self.status(as_of),
                "forecast_current": lambda: self.current(as_of),
                "accuracy": lambda: R.accuracy_report(self.accuracy()),
                "leaderboard": lambda: R.leaderboard(self.accuracy()),
                "models": lambda: self.models(as_of),
                "integrity": lambda: R.register_size(self.points()),
                "plan": lambda: P.plan(self.current(as_of), self._request(C.PLAN_DEFAULTS), KEYS),
            },
            out, as_of, commit, {"plan": C.PLAN_DEFAULTS},
        )

    def current(self, as_of: datetime) -> DataFrame:
        """The latest run of whoever is champion."""
        return R.current_forecast(self.points(), self.models(as_of), KEYS)

    def _request(self, wish: dict[str, float]) -> DataFrame:
        cells = [F.lit(float(v)).alias(k) for k, v in wish.items()]
        return self.spark.range(1).select(
            F.lit("default").alias("request_id"), F.lit("national").alias("series_key"), *cells
        )

    # ---- registry and ledger ------------------------------------------------
    def _rows(self, layer: str, name: str, schema: str) -> DataFrame:
        stored = self.table(layer, name)
        return self.spark.createDataFrame([], schema) if stored is None else stored

    def register_model(self, rows: DataFrame) -> int:
        """Add models to the registry; one that is known stays as it is."""
        return S.append_new(
            self.spark, rows, self.path("register", "reg_model_version"), ["model_version"]
        )

    def record_promotion(self, events: DataFrame) -> int:
        """Append evaluations of challengers, promoting or not; refuse those that break the contract."""
        models = self._rows("register", "reg_model_version", G.MODEL)
        broken = G.event_violation(events, models, self.table("register", "reg_promotion_event"))
        first = broken.select("promotion_id", "violation").first()
        if first is not None:
            raise RegisterError(f"promotion {first['promotion_id']}: {first['violation']}")
        return S.append_new(
            self.spark, events, self.path("register", "reg_promotion_event"), ["promotion_id"]
        )

    def models(self, as_of: datetime) -> DataFrame:
        """The models with their roles at an instant; without a registry the seasonal model is champion."""
        models = self._rows("register", "reg_model_version", G.MODEL)
        if models.isEmpty():
            issued = self.points().groupBy("model_version").agg(F.min("run_at_utc").alias("created_at_utc"))
            role = F.when(F.col("model_version") == I.CHAMPION, "champion").otherwise("challenger")
            return issued.withColumn("role", role).withColumn("role_since_utc", F.col("created_at_utc"))
        return G.roles(models, self._rows("register", "reg_promotion_event", G.EVENT), instant(as_of))

    def record_usage(self, job: str, at: datetime, rows: int, size: int, queries: int = 1) -> None:
        """One row a run in the transfer ledger; a run that asked nothing leaves none."""
        if queries:
            row = [(at, job, queries, rows, size)]
            self.spark.createDataFrame(row, LEDGER).coalesce(1).write.mode("append").parquet(
                self.path("landing", "db_transfer")
            )

    def stands_down(self, as_of: datetime, **usage) -> bool:
        """Whether work that can wait a day should: the transfer budget is spent. Issuing and scoring never ask."""
        ledger = self._rows("landing", "db_transfer", LEDGER)
        return status.usage_state(ledger, as_of, **usage).first()["state"] == "over"

    def status(self, as_of: datetime, **usage) -> DataFrame:
        """G3."""
        ledger = self._rows("landing", "db_transfer", LEDGER)
        runs = self._rows("landing", "run_log", runlog.SCHEMA)
        return status.status(self.spine(as_of), runs, ledger, as_of, **usage)

    def backtest(self, grid: C.Grid, run_id: str) -> DataFrame:
        """The summary of one backtest, stored apart from live results."""
        facts = self.facts()
        summary = B.summarise(
            B.backtest(facts, grid, KEYS), naive_scale_positional(facts, KEYS), KEYS
        ).withColumn("bt_run_id", F.lit(run_id))
        S.append_counted(summary, self.path("backtest", "bt_score"))
        return self.table("backtest", "bt_score").where(F.col("bt_run_id") == run_id)

    def audit_pack(self, as_of: datetime) -> dict[str, Callable[[], DataFrame]]:
        """Q11: the named audits over this warehouse."""
        now, land_rows = instant(as_of), self.landing("ci_intensity")
        bands = audits.banded(land_rows, [TIME])
        return {
            "A01_coverage_by_year": lambda: audits.coverage_by_year(self.spine(as_of), land_rows, now),
            "A02_structural_gaps": lambda: audits.structural_gaps(self.spine(as_of), land_rows, now),
            "A03_source_coverage": lambda: audits.source_spans(
                {"lnd_ci_intensity": (land_rows, TIME)}, self.spine(as_of), now
            ),
            "B01_unscoreable_periods": lambda: audits.unscoreable_by_year(land_rows, now),
            "B02_conflicting_versions": lambda: audits.conflicts(land_rows),
            "B03_band_ranges": lambda: audits.band_ranges(bands),
            "B04_band_drift": lambda: audits.band_drift(bands),
            "C01_mix_sum_tolerance": lambda: audits.mix_sum_distribution(
                self.table("marts", "fct_mix_wide")
            ),
            "C02_fuel_set_stability": lambda: audits.fuel_sets(
                ST.stg_genmix(self.landing("ci_genmix"))
            ),
            "D01_demand_publication_lag": lambda: audits.publication_lag(
                ST.stg_demand(self.landing("ex_demand"))
            ),
            "E01_weather_location_correlation": lambda: audits.location_corr(
                M.fct_weather_period(self.table("marts", "fct_weather_hour"), self.spine(as_of)),
                self.table("marts", "fct_mix_wide"),
            ),
        }
