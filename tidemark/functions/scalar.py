"""Column expressions: JSON access, time arithmetic, flags and text forms.

All of them are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(at: datetime | str) -> Column:
    """A UTC instant literal; it takes the place of now()."""
    text = at if isinstance(at, str) else at.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp")


# ---- JSON -------------------------------------------------------------------
def json_get(j, path: str) -> Column:
    return F.get_json_object(col(j), path if path.startswith("$") else f"$.{path}")


def json_text(j, path: str, cast: str = "string") -> Column:
    """A JSON leaf as text, then cast, so that "7" and 7 both become a number."""
    return json_get(j, path).cast(cast)


def json_each(df: DataFrame, j: str, element_ddl: str, alias: str = "item") -> DataFrame:
    """One row per element of a JSON array; the element fields are text leaves."""
    return df.withColumn(alias, F.explode(F.from_json(F.col(j), f"array<{element_ddl}>")))


def canonical_json(j) -> Column:
    """Key-sorted compact JSON that keeps nulls; key order in the input is lost."""
    return F.to_json(F.parse_json(col(j)))


def canonical_hash(j) -> Column:
    return F.sha2(canonical_json(j), 256)


# ---- time -------------------------------------------------------------------
def epoch(ts) -> Column:
    return F.unix_timestamp(col(ts))


def add_seconds(ts, seconds) -> Column:
    """Shift an instant by seconds, a Python number or a column."""
    by = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(col(ts)) + by.cast("long") * 1000000)


def floor_to(ts, seconds: int = C.STEP_SECONDS) -> Column:
    at = epoch(ts)
    return F.timestamp_seconds(at - F.pmod(at, F.lit(seconds)))


def seconds_between(later, earlier) -> Column:
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(1e6)


def lag_minutes(published, start) -> Column:
    return F.round(seconds_between(published, start) / 60)


def period_of_day(ts) -> Column:
    return F.hour(col(ts)) * 2 + (F.minute(col(ts)) >= 30).cast("int")


def weekday_mon0(ts) -> Column:
    return F.weekday(col(ts))


def isodow(ts) -> Column:
    return F.weekday(col(ts)) + 1


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def to_local(ts, tz: str = "Europe/London") -> Column:
    """Local wall-clock time: for presentation, never a join key."""
    return F.from_utc_timestamp(col(ts), tz)


def is_dst(ts, tz: str = "Europe/London") -> Column:
    return (epoch(to_local(ts, tz)) - epoch(ts)) == 3600


def parse_iso(text) -> Column:
    """ISO text to an instant. Feeds leave out the seconds, which Spark requires."""
    full = F.regexp_replace(col(text), r"(T\d\d:\d\d)(Z|[+-]\d\d:\d\d)?$", "$1:00$2")
    return F.to_timestamp(full)


def iso_text(ts) -> Column:
    """One fixed text form of an instant, for keys and hashes."""
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def seasons_back(high: int, season: int = C.SEASON_DAY) -> int:
    """Rows a band that ends at ``high`` must step back: whole seasons."""
    return max(1, -(-high // season)) * season


# ---- small forms ------------------------------------------------------------
def text_key(*cols) -> Column:
    return F.concat_ws("|", *[col(c) for c in cols])


def all_null(*cols) -> Column:
    return F.coalesce(*[col(c) for c in cols]).isNull()


def is_finite(x) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))


def sort4(*cols) -> Column:
    return F.array_sort(F.array(*[col(c) for c in cols]))


def clip(text, n: int) -> Column:
    return F.substring(col(text), 1, n)


def horizon_group(h) -> Column:
    """H1 to H4; anything past H3 counts as H4."""
    h = col(h)
    (g1, _, e1), (g2, _, e2), (g3, _, e3), (g4, _, _) = C.HORIZON_GROUPS
    return F.when(h <= e1, g1).when(h <= e2, g2).when(h <= e3, g3).otherwise(g4)


def opt_filter(df: DataFrame, column: str, value) -> DataFrame:
    """Filter only when a value was asked for."""
    return df if value is None else df.where(F.col(column) == F.lit(value))


# ---- flags of a period ------------------------------------------------------
def signed_error(forecast, actual) -> Column:
    return col(forecast) - col(actual)


def older_than(ts, as_of: Column, hours: int) -> Column:
    return col(ts) < as_of - F.expr(f"interval {hours} hours")


def is_matured(sp, revisions, knowable, as_of: Column) -> Column:
    """Old enough, and either never revised or unrevised for some hours."""
    return older_than(sp, as_of, C.MATURITY_HOURS) & (
        (col(revisions) == 1) | older_than(knowable, as_of, C.STABILITY_HOURS)
    )


def is_unscoreable(actual, sp, as_of: Column) -> Column:
    return col(actual).isNull() & older_than(sp, as_of, C.MATURITY_HOURS)


def plausible(v, top=C.PLAUSIBLE_MAX) -> Column:
    """Present and in range; false rather than null when the value is missing."""
    return col(v).isNotNull() & col(v).between(0, top)


def is_comparable(actual, benchmark, top=C.PLAUSIBLE_MAX) -> Column:
    return plausible(actual, top) & plausible(benchmark, top)


def effective_knowable(sp, knowable, reconstructed, lag_hours: int = C.RECONSTRUCTED_LAG_HOURS):
    return F.when(
        col(reconstructed), col(sp) + F.expr(f"interval {lag_hours} hours")
    ).otherwise(col(knowable))
