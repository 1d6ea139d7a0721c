"""Constants of the data contract, and the description of each source."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

# --- Fixed values: they decide results, so they are stated once, here ---------
STEP_SECONDS = 1800
DAY_SECONDS = 86400
HORIZONS = 96
SEASON_DAY = 48
SEASON_WEEK = 336
WALKBACK_STEPS = 14

HORIZON_GROUPS = (("H1", 1, 6), ("H2", 7, 24), ("H3", 25, 48), ("H4", 49, 96))
QUANTILE_LEVELS = {"q025": 0.025, "q10": 0.10, "q90": 0.90, "q975": 0.975}

LOW_CARBON_FUELS = ("wind", "solar", "hydro", "nuclear", "biomass")
FOSSIL_FUELS = ("gas", "coal")
WIDE_FUELS = ("wind", "solar", "gas", "coal", "nuclear", "imports")

WEATHER_VARIABLES = ("temperature_2m", "wind_speed_100m", "shortwave_radiation", "cloud_cover")
LOCATIONS = (
    "scotland_north",
    "scotland_south",
    "north_sea",
    "irish_sea",
    "midlands",
    "south_coast",
)
FEATURE_LOCATIONS = LOCATIONS[1:]

MATURITY_HOURS = 24
STABILITY_HOURS = 6
RECONSTRUCTED_AFTER_DAYS = 30
RECONSTRUCTED_LAG_HOURS = 24
PLAUSIBLE_MAX = 800
LOOKBACK_DAYS = 14
EMBARGO_HOURS = 24
GAP_GRACE_HOURS = 3
CLIMATOLOGY_DAYS = 3 * 365
CALIBRATION_DAYS = 365
CALIBRATION_MIN_ROWS = 8 * SEASON_DAY
CALIBRATION_STALE_DAYS = 3
SCALE_YEARS = 2

LAG_HOURS = (0, 24, 48, 168)
ROLLING_HOURS = (24, 168)
RAMP_ROWS = 48

MIN_PUBLISHABLE_N = 200
HIT_PERCENT_RANK = 0.3334
HIT_MIN_CANDIDATES = 3
TRANSFER_BUDGET_BYTES = 5 * 1024**3
WARN_FRACTION = 0.75
OVER_FRACTION = 0.90

BANNED_COLUMNS = ("index", "intensity_index", "index_band")
BANNED_FEATURES = BANNED_COLUMNS + ("actual", "benchmark")
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    """Issue times: every ``step_hours`` from ``start``.

    ``include_end`` is True for backtests and False for training. A single live
    issue time is a grid whose start and end coincide.
    """

    start: datetime
    end: datetime
    step_hours: int = 24
    include_end: bool = True

    @property
    def step_seconds(self) -> int:
        return self.step_hours * 3600

    @property
    def count(self) -> int:
        span = int((self.end - self.start).total_seconds())
        if span < 0 or (span == 0 and not self.include_end):
            return 0
        whole, rest = divmod(span, self.step_seconds)
        return whole + (1 if self.include_end or rest else 0)

    @classmethod
    def single(cls, at: datetime) -> "Grid":
        return cls(at, at, 24, True)


@dataclass(frozen=True)
class Source:
    """What the ingest side must know about one feed."""

    name: str
    table: str
    keys: tuple[str, ...]
    time_column: str
    max_window: timedelta
    gap_checkable: bool = True
    deferred: bool = False
    backward_only: bool = False
    keep_days: int | None = None
    required_mart: str | None = None


SOURCES = {
    s.name: s
    for s in (
        Source("ci_intensity", "lnd_ci_intensity", ("sp_start_utc",), "sp_start_utc",
               timedelta(days=28)),
        Source("ci_genmix", "lnd_ci_genmix", ("sp_start_utc",), "sp_start_utc",
               timedelta(days=28), keep_days=30, required_mart="fct_mix_wide"),
        Source("ci_regional", "lnd_ci_regional", ("sp_start_utc", "region_id"), "sp_start_utc",
               timedelta(days=7), deferred=True, keep_days=30),
        Source("ex_demand", "lnd_ex_demand", ("sp_start_utc", "publish_time_utc"), "sp_start_utc",
               timedelta(days=21), keep_days=30, required_mart="fct_demand_period"),
        Source("ex_price", "lnd_ex_price", ("sp_start_utc", "data_provider"), "sp_start_utc",
               timedelta(days=21), deferred=True),
        Source("om_archive", "lnd_om_archive", ("location_id", "hour_start_utc"),
               "hour_start_utc", timedelta(days=90), gap_checkable=False, backward_only=True,
               keep_days=7),
        Source("om_forecast", "lnd_om_forecast", ("location_id", "hour_start_utc"),
               "hour_start_utc", timedelta(days=3), gap_checkable=False, keep_days=3),
        Source("om_vintage", "lnd_om_vintage", ("location_id", "hour_start_utc"),
               "hour_start_utc", timedelta(days=30), gap_checkable=False, backward_only=True,
               keep_days=7, required_mart="fct_weather_hour"),
    )
}
SCHEDULED = ("ci_intensity", "ci_genmix", "ex_demand", "om_forecast")
DAILY = ("om_archive",)

# The request that the published plan answers.
PLAN_DEFAULTS = {"duration_hours": 2.0, "within_hours": 24.0, "appliance_kwh": 1.4}
