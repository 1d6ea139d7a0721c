"""Views over the driver's tables in the shapes the operators expect."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import add_seconds, floor_to, instant, lag_minutes
from tidemark.operators.ordering import naive_scale_time
from tidemark.plans.calibrate import error_quantiles
from tidemark.plans.issue import issue_persistence, issue_published, issue_seasonal, issue_targets
from tidemark.plans.marts import fct_intensity_period, mix_wide, weather_wide
from tidemark.plans.register import score
from tidemark.session import configure, scratch_dir
from tidemark.sources.spine import spine_of

UTC = timezone.utc
AS_OF = datetime(2024, 1, 31, tzinfo=UTC)
GRID = C.Grid(datetime(2024, 1, 8, tzinfo=UTC), datetime(2024, 1, 27, tzinfo=UTC), 24, True)
TRAIN_GRID = C.Grid(
    datetime(2024, 1, 8, tzinfo=UTC), datetime(2024, 1, 24, tzinfo=UTC), 12, False
)
KEYS = ("series_key",)

# Which event type stands for which fuel and location.
FUEL_OF = {
    "click": "wind",
    "error": "coal",
    "purchase": "gas",
    "signup": "solar",
    "view": "nuclear",
}
LOCATION_OF = {
    "click": "north_sea",
    "error": "irish_sea",
    "purchase": "midlands",
    "signup": "south_coast",
    "view": "scotland_south",
}
ABSENT = (
    ("2024-01-06 20:00:00", "2024-01-06 22:00:00"),
    ("2024-01-08 07:00:00", "2024-01-08 08:00:00"),
)


def _mapped(column: str, table: dict[str, str]):
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[F.col(column)]


class Tables:
    """Lazy views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir
        self._stored: dict[str, str] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def as_of(self):
        return instant(AS_OF)

    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
            "v", F.col("value").cast("decimal(12,2)")
        )

    def orders(self) -> DataFrame:
        return self.raw("orders").withColumn(
            "sp_start_utc", F.col("o_orderdate").cast("timestamp")
        )

    def landing(self) -> DataFrame:
        return self.events().select(
            F.col("event_id").alias("landing_id"),
            F.col("user_id").alias("series_key"),
            F.date_trunc("day", "ts").alias("sp_start_utc"),
            F.col("props").alias("payload"),
            F.sha2("props", 256).alias("payload_hash"),
            F.date_trunc("hour", "ts").alias("fetched_at_utc"),
        )

    def busy(self) -> DataFrame:
        """Landing rows of few keys and few payloads, so that most keys are seen again."""
        return self.events().select(
            F.col("event_id").alias("landing_id"),
            (F.col("user_id") % 7).alias("series_key"),
            F.date_trunc("month", "ts").alias("sp_start_utc"),
            (F.floor("value") % 3).cast("string").alias("payload"),
            F.sha2((F.floor("value") % 3).cast("string"), 256).alias("payload_hash"),
            F.date_trunc("hour", "ts").alias("fetched_at_utc"),
        )

    def halves(self, *by, benchmark) -> DataFrame:
        return (
            self.events()
            .groupBy(*by, floor_to("ts").alias("sp_start_utc"))
            .agg(
                F.sum("v").cast("decimal(14,2)").alias("actual"),
                F.sum(F.when(benchmark, F.col("v"))).cast("decimal(14,2)").alias("benchmark"),
                F.min("ts").alias("first_seen_at_utc"),
                F.max("ts").alias("knowable_at_utc"),
                F.count(F.lit(1)).alias("revision_count"),
            )
        )

    def hh(self) -> DataFrame:
        """The national series."""
        rows = self.halves(benchmark=F.col("event_type") != "error")
        return rows.withColumn("series_key", F.lit("all")).withColumn(
            "is_comparable", F.col("benchmark").isNotNull()
        )

    def panel(self) -> DataFrame:
        """One series per event type."""
        by = F.col("event_type").alias("series_key")
        return self.halves(by, benchmark=F.col("value") >= 5)

    def user_panel(self) -> DataFrame:
        """One series per user."""
        by = F.col("user_id").alias("series_key")
        return self.halves(by, benchmark=F.col("value") >= 5)

    def spine(self) -> DataFrame:
        return spine_of(self.events(), "ts")

    def long_spine(self) -> DataFrame:
        """Half hours over the span of the orders table, several years."""
        return spine_of(self.orders())

    def absent_windows(self) -> DataFrame:
        rows = ", ".join(
            f"(timestamp'{a}', timestamp'{b}', 'hh', 'registered', date'2024-01-31')"
            for a, b in ABSENT
        )
        return self.spark.sql(
            "select * from values " + rows
            + " as t(window_from_utc, window_to_utc, source, reason, verified_on)"
        )

    def absent(self) -> DataFrame:
        from tidemark.plans.marts import mart_absent_periods

        return mart_absent_periods(self.absent_windows(), self.spine())

    def facts(self) -> DataFrame:
        """The panel with its lifecycle flags: a stored mart."""
        return self.stored("facts", self.built_facts)

    def built_facts(self) -> DataFrame:
        return fct_intensity_period(self.panel(), self.absent(), self.as_of)

    def mix(self) -> DataFrame:
        """Shares of each half hour's total, in exact integer arithmetic."""
        by_type = self.events().groupBy(
            floor_to("ts").alias("sp_start_utc"), "event_type"
        ).agg(
            (F.sum("v") * 100).cast("bigint").alias("cents"),
            F.max("ts").alias("knowable_at_utc"),
        )
        totals = by_type.groupBy("sp_start_utc").agg(F.sum("cents").alias("total"))
        share = F.expr("(cents * 20000 + total) div (2 * total)")
        fuel = _mapped("event_type", FUEL_OF)
        return (
            by_type.join(totals.where(F.col("total") != 0), "sp_start_utc")
            .select(
                "sp_start_utc",
                fuel.alias("fuel"),
                (share / F.lit(100)).cast("decimal(5,2)").alias("perc"),
                "knowable_at_utc",
            )
            .withColumn("is_low_carbon", F.col("fuel").isin(*C.LOW_CARBON_FUELS))
            .withColumn("is_fossil", F.col("fuel").isin(*C.FOSSIL_FUELS))
        )

    def mix_json(self) -> DataFrame:
        """One row per half hour with the fuel array as text, as a feed sends it."""
        cell = F.struct("fuel", F.col("perc").cast("string").alias("perc"))
        return self.mix().groupBy("sp_start_utc").agg(
            F.to_json(F.array_sort(F.collect_list(cell))).alias("mix_json"),
            F.max("knowable_at_utc").alias("fetched_at_utc"),
        )

    def mix_wide(self) -> DataFrame:
        return mix_wide(self.mix())

    def stored_mix(self) -> DataFrame:
        return self.stored("mix_wide", self.mix_wide)

    def weather_hour(self) -> DataFrame:
        return (
            self.events()
            .groupBy(
                _mapped("event_type", LOCATION_OF).alias("location_id"),
                F.date_trunc("hour", "ts").alias("hour_start_utc"),
            )
            .agg(
                F.sum("v").cast("decimal(14,2)").alias("wind_speed_100m_kmh"),
                F.count(F.lit(1)).cast("decimal(14,2)").alias("temperature_2m_c"),
                F.max("v").alias("shortwave_radiation_wm2"),
                F.min("v").alias("cloud_cover_pct"),
                F.max("ts").alias("knowable_at_utc"),
            )
        )

    def weather_period(self) -> DataFrame:
        from tidemark.plans.marts import fct_weather_period

        return fct_weather_period(self.weather_hour(), self.spine())

    def weather_wide(self) -> DataFrame:
        return weather_wide(self.weather_period())

    def stored_weather(self) -> DataFrame:
        return self.stored("weather_wide", self.weather_wide)

    def vintage(self) -> DataFrame:
        return (
            self.events()
            .groupBy(floor_to("ts").alias("sp_start_utc"), "user_id")
            .agg(
                F.max("ts").alias("publish_time_utc"),
                F.max("event_id").alias("landing_id"),
                F.sum("v").cast("decimal(14,2)").alias("demand_mw"),
            )
            .withColumn("publish_lag_minutes", lag_minutes("publish_time_utc", "sp_start_utc"))
        )

    def calibration(self) -> DataFrame:
        return error_quantiles(self.facts(), KEYS)

    def stored(self, name: str, build) -> DataFrame:
        """A frame written once to the shared folder and read back.

        The register is a stored table: what reads it must not issue it again,
        and a lost executor must not either.
        """
        if name not in self._stored:
            path = scratch_dir(self.spark, name)
            build().write.parquet(path)
            self._stored[name] = path
        return self.spark.read.parquet(self._stored[name])

    def points(self) -> DataFrame:
        return self.stored("points", self.issued)

    def issued(self) -> DataFrame:
        """Three models issued daily on the panel; the third stops two horizons short."""
        panel = self.facts()
        targets = issue_targets(panel, GRID, KEYS)
        short = targets.where(F.col("horizon") <= C.HORIZONS - 2)
        return (
            issue_seasonal(panel, targets, KEYS, self.calibration())
            .unionByName(issue_persistence(panel, targets, KEYS))
            .unionByName(
                issue_published(panel.select(*KEYS, "sp_start_utc", "benchmark"), short, KEYS)
            )
        )

    def scale(self) -> DataFrame:
        return naive_scale_time(self.facts(), KEYS, self.as_of)

    def scores(self) -> DataFrame:
        return self.stored("scores", self.scored)

    def scored(self) -> DataFrame:
        return score(self.points(), self.facts(), self.scale(), None, KEYS)

    def registry(self) -> DataFrame:
        return self.spark.sql(
            "select * from values ('B1_seasonal_naive_q_v1', 'champion'), "
            "('B0_persistence_v1', 'challenger'), ('published_benchmark', 'challenger') "
            "as t(model_version, role)"
        )

    def requests(self) -> DataFrame:
        """Every event asks for a load of its own size, search length and energy."""
        return self.events().select(
            F.col("event_id").alias("request_id"),
            F.col("event_type").alias("series_key"),
            ((F.lit(1) + F.floor("value") % 16) / 2.0).cast("double").alias("duration_hours"),
            (F.lit(1) + F.col("user_id") % 48).cast("double").alias("within_hours"),
            F.least(F.col("value"), F.lit(100.0)).alias("appliance_kwh"),
        )

    def ledger(self) -> DataFrame:
        return (
            self.events()
            .groupBy(F.date_trunc("day", "ts").alias("recorded_at_utc"), "event_type")
            .agg(
                F.count(F.lit(1)).alias("queries"),
                F.count(F.lit(1)).alias("rows_returned"),
                F.sum(F.length("props")).alias("bytes_estimated"),
            )
        )

    def run_log(self) -> DataFrame:
        """A run per day and event type."""
        return self.ledger().select(
            F.concat_ws("/", F.col("event_type"), F.date_format("recorded_at_utc", "yyyy-MM-dd"))
            .alias("run_id"),
            F.col("event_type").alias("source"),
            F.lit("ingest").alias("job"),
            F.col("recorded_at_utc").alias("started_at_utc"),
            add_seconds("recorded_at_utc", 60).alias("finished_at_utc"),
            F.col("rows_returned").alias("rows_read"),
            F.col("queries").alias("rows_written"),
            F.lit("success").alias("status"),
        )
