"""The audit pack: named questions about what the data really contains (Q11)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import json_get, json_text, seconds_between
from tidemark.operators.joins import coverage_join, missing, weather_mix
from tidemark.operators.ordering import TIME, islands
from tidemark.operators.percentiles import exact_percentiles
from tidemark.operators.versions import conflicting_versions, latest_row


def _pct(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.lit(100) * part / whole, digits)


def landed(landing: DataFrame, keys: Sequence[str] = (TIME,)) -> DataFrame:
    """A30."""
    return landing.select(*keys).distinct()


def coverage_by_year(spine: DataFrame, landing: DataFrame, as_of: Column, since: Column | None = None):
    """A01 (J3, A6): spine against landing, by year."""
    past = spine.where(F.col(TIME) < as_of)
    if since is not None:
        past = past.where(F.col(TIME) >= since)
    n, held = F.count(F.lit(1)), F.count("landed_utc")
    return (
        coverage_join(past, landed(landing))
        .groupBy(F.year(TIME).alias("year"))
        .agg(
            n.alias("spine_periods"),
            held.alias("landed_periods"),
            (n - held).alias("missing"),
            _pct(held, n, 3).alias("pct_covered"),
        )
    )


def structural_gaps(spine: DataFrame, landing: DataFrame, as_of: Column) -> DataFrame:
    """A02 (J4, W4)."""
    return islands(missing(spine.where(F.col(TIME) < as_of), landed(landing)))


def source_spans(tables: dict[str, tuple[DataFrame, str]], spine: DataFrame, as_of: Column):
    """A03 (A7, U1, J11): what each source covers of the history."""
    parts = [
        df.agg(
            F.min(t).alias("first_utc"), F.max(t).alias("last_utc"), F.countDistinct(t).alias("periods")
        ).withColumn("source", F.lit(name))
        for name, (df, t) in tables.items()
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    span = spine.agg(
        F.struct(
            F.min(TIME).alias("a"), F.max(F.when(F.col(TIME) < as_of, F.col(TIME))).alias("b")
        )
    )
    days = F.datediff("last_utc", "first_utc")
    history = F.datediff("__span.b", "__span.a")
    return stacked.withColumn("__span", span.scalar()).select(
        "source",
        F.to_date("first_utc").alias("covers_from"),
        F.to_date("last_utc").alias("covers_to"),
        "periods",
        F.when(F.col("last_utc").isNull(), 0.0)
        .otherwise(F.round(F.lit(100) * days / F.nullif(history, F.lit(0)), 1))
        .alias("pct_of_history_span"),
    )


def unscoreable_by_year(
    landing: DataFrame,
    as_of: Column,
    keys: Sequence[str] = (TIME,),
    actual_path: str = "intensity.actual",
    benchmark_path: str = "intensity.forecast",
) -> DataFrame:
    """B01 (A8): current rows older than a week with a null actual or benchmark."""
    n = F.count(F.lit(1))
    no_actual = F.count_if(json_get("payload", actual_path).isNull())
    return (
        latest_row(landing, keys)
        .where(F.col(TIME) < as_of - F.expr("interval 7 days"))
        .groupBy(F.year(TIME).alias("year"))
        .agg(
            n.alias("periods"),
            no_actual.alias("null_actual"),
            _pct(no_actual, n, 3).alias("pct_null_actual"),
            F.count_if(json_get("payload", benchmark_path).isNull()).alias("null_benchmark"),
        )
    )


def conflicts(landing: DataFrame, keys: Sequence[str] = (TIME,)) -> DataFrame:
    """B02 (A9)."""
    typed = landing.withColumn(
        "actual", json_text("payload", "intensity.actual")
    ).withColumn("forecast", json_text("payload", "intensity.forecast"))
    return conflicting_versions(typed, keys, ["actual", "forecast"])


def banded(landing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        latest_row(landing, keys)
        .withColumn("actual", json_text("payload", "intensity.actual", "int"))
        .withColumn("band", json_text("payload", "intensity.index"))
        .where(F.col("actual").isNotNull())
    )


def band_ranges(rows: DataFrame) -> DataFrame:
    """B03 (A10): range and years of each band."""
    return rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("periods"),
        F.min("actual").alias("min_actual"),
        F.max("actual").alias("max_actual"),
        F.min(F.year(TIME)).alias("first_year"),
        F.max(F.year(TIME)).alias("last_year"),
    )


def band_drift(rows: DataFrame, low="low", moderate="moderate", high="high", by=None) -> DataFrame:
    """B04 (A11): the border values of the bands, per year."""

    def border(band: str, agg) -> Column:
        return agg(F.when(F.col("band") == band, F.col("actual")))

    return rows.groupBy((by if by is not None else F.year(TIME)).alias("year")).agg(
        border(moderate, F.max).alias("highest_moderate"),
        border(high, F.min).alias("lowest_high"),
        border(low, F.max).alias("highest_low"),
        border(moderate, F.min).alias("lowest_moderate"),
    )


def array_sums(current: DataFrame, array_json: str = "mix_json") -> DataFrame:
    """The sum over each row's fuel array, in place."""
    fuels = F.from_json(F.col(array_json), "array<struct<fuel:string,perc:string>>")
    total = F.aggregate(
        fuels,
        F.lit(0).cast("decimal(20,4)"),
        lambda acc, x: (acc + x["perc"].cast("decimal(12,4)")).cast("decimal(20,4)"),
    )
    return current.withColumn("total_perc", total)


def mix_sum_distribution(sums: DataFrame) -> DataFrame:
    """C01 (A12, W6): how often each total occurs, and its share of all."""
    counts = sums.groupBy(F.round("total_perc", 1).alias("mix_sum")).agg(
        F.count(F.lit(1)).alias("periods")
    )
    return share_of_total(counts, "periods", "pct_of_all", 4)


def share_of_total(counts: DataFrame, n: str, out: str, digits: int = 4) -> DataFrame:
    """Each row's percentage of the sum, taken as a one-row subquery."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn(out, F.round(F.lit(100.0) * F.col(n) / total, digits))


def fuel_sets(rows: DataFrame, period: Column | None = None) -> DataFrame:
    """C02 (A13): the ordered set of categories per year."""
    each = rows.select((period if period is not None else F.year(TIME)).alias("year"), "fuel")
    return each.distinct().groupBy("year").agg(
        F.count("fuel").alias("distinct_fuels"),
        F.expr("listagg(fuel, ', ') within group (order by fuel)").alias("fuel_set"),
    )


def publication_lag(demand: DataFrame, publish: str = "publish_time_utc") -> DataFrame:
    """D01 (A14): exact percentiles of the lag, and impossible negative lags."""
    rows = demand.withColumn("__lag", seconds_between(publish, TIME) / 60)
    levels = {"p50_lag_min": 0.5, "p95_lag_min": 0.95, "p99_lag_min": 0.99}
    facts = rows.agg(
        F.count(F.lit(1)).alias("observations"),
        F.countDistinct(TIME).alias("periods"),
        F.round(F.min("__lag")).alias("min_lag_min"),
        F.round(F.max("__lag")).alias("max_lag_min"),
        F.count_if(F.col("__lag") < 0).alias("impossible_negative_lags"),
    )
    points = exact_percentiles(rows, [], "__lag", levels)
    packed = points.select(F.struct(*[F.round(n).alias(n) for n in levels])).scalar()
    return facts.withColumn("__p", packed).select(*facts.columns, "__p.*")


def location_corr(weather: DataFrame, mix: DataFrame) -> DataFrame:
    """E01 (A15, J12): which locations move with the grid."""

    def corr(a: str, b: str) -> Column:
        return F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 4)

    return (
        weather_mix(weather, mix.drop("knowable_at_utc"))
        .where(F.col("wind_perc").isNotNull())
        .groupBy("location_id")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            corr("wind_speed_100m_kmh", "wind_perc").alias("corr_wind_share"),
            corr("temperature_2m_c", "wind_perc").alias("corr_temp_wind_share"),
            corr("shortwave_radiation_wm2", "solar_perc").alias("corr_solar_share"),
            F.round(F.avg(F.col("wind_speed_100m_kmh").cast("double")), 1).alias("mean_wind_kmh"),
        )
    )


def run_audit(
    pack: dict[str, Callable[[], DataFrame]], out: str, prefix: str | None = None, show: int = 20
) -> dict[str, dict]:
    """Q11: the audits whose name starts with ``prefix``; one failure stops no other.

    Every result is stored whole under ``out``; ``n_rows`` is its true count and
    ``rows`` its first ``show`` rows, for printing.
    """
    report = {}
    for name, build in sorted(pack.items()):
        if prefix and not name.lower().startswith(prefix.lower()):
            continue
        try:
            rows, path = build(), f"{out.rstrip('/')}/{name}"
            rows.write.mode("overwrite").parquet(path)
            stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
            report[name] = {
                "ok": True, "columns": rows.columns, "n_rows": stored.count(),
                "rows": stored.take(show), "path": path,
            }
        except Exception as exc:  # noqa: BLE001 - the others must still run
            report[name] = {"ok": False, "error": type(exc).__name__, "detail": str(exc)[:500]}
    return report
