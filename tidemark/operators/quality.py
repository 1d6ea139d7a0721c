"""Assertions: each returns the violating rows, so an empty result passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators.joins import covered_days
from tidemark.operators.ordering import TIME, spine_steps


# ---- Q1: generic ------------------------------------------------------------
def check_unique(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_not_null(df: DataFrame, *cols: str) -> DataFrame:
    """One row per column with its count of nulls; a single pass for all columns."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"))
            for c in cols
        ]
    )
    return df.agg(cells.alias("c")).select(F.inline("c")).where(F.col("nulls") > 0)


def check_accepted(df: DataFrame, column: str, accepted: Sequence) -> DataFrame:
    bad = F.col(column).isNotNull() & ~F.col(column).isin(*accepted)
    return df.where(bad).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


# ---- Q2 to Q9 ---------------------------------------------------------------
def check_category_count(mix: DataFrame, n: int = 9, keys: Sequence[str] = (TIME,)) -> DataFrame:
    """Q2."""
    counts = mix.groupBy(*keys).agg(F.count(F.lit(1)).alias("fuels_reported"))
    return counts.where(F.col("fuels_reported") != n)


def check_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Q3: rows with a value outside its range; nulls pass."""
    bad = F.lit(False)
    for c, (lo, hi) in bounds.items():
        bad = bad | F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
    return df.where(bad)


def check_matured_have_actual(fact: DataFrame) -> DataFrame:
    """Q4."""
    return fact.where(
        F.col("is_matured")
        & F.col("actual").isNull()
        & ~F.col("is_permanently_unscoreable")
        & ~F.col("is_known_absent_upstream")
    )


def check_mart_is_current(fact: DataFrame, staged: DataFrame, keys=(TIME,)) -> DataFrame:
    """Rows whose stored values differ from landing's current ones; Q4 cannot see these."""
    now = staged.select(
        *keys, F.col("actual").alias("__a"), F.col("benchmark").alias("__b")
    )
    same = F.col("actual").eqNullSafe(F.col("__a")) & F.col("benchmark").eqNullSafe(F.col("__b"))
    return fact.join(now, list(keys), "left").where(~same).drop("__a", "__b")


def check_sum(wide: DataFrame, total: float = 100, tolerance: float = 0.5) -> DataFrame:
    """Q5."""
    return wide.where(F.abs(F.col("total_perc") - total) > tolerance)


def check_no_column(spark: SparkSession, names: Sequence[str] = C.BANNED_COLUMNS, db=None):
    """Q6: tables and views of the catalog that carry a banned column."""
    found = [
        (t.name, c.name)
        for t in spark.catalog.listTables(db)
        for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{db or 'default'}.{t.name}")
        if c.name in names
    ]
    return spark.createDataFrame(found, "table_name string, column_name string")


def day_counts(spine: DataFrame, day: str = "settlement_date_local") -> DataFrame:
    return spine.groupBy(day).agg(F.count(F.lit(1)).alias("n_periods"))


def check_periods_per_day(spine: DataFrame, day: str = "settlement_date_local") -> DataFrame:
    """Q7: inner local days without 46, 48 or 50 periods."""
    counts = day_counts(spine, day)
    first = spine.agg(F.min(day)).scalar()
    last = spine.agg(F.max(day)).scalar()
    return counts.where(
        (F.col(day) > first) & (F.col(day) < last) & ~F.col("n_periods").isin(46, 48, 50)
    )


def check_spine_step(spine: DataFrame, step: int = C.STEP_SECONDS) -> DataFrame:
    """Q8."""
    return spine_steps(spine).where(F.col("step_seconds") != step)


def clock_changes(spine: DataFrame, day: str = "settlement_date_local") -> DataFrame:
    """Days per fully covered year that do not have 48 periods."""
    counts = day_counts(spine, day).withColumn("yr", F.year(day))
    years = (
        counts.groupBy("yr")
        .agg(F.min(day).alias("a"), F.max(day).alias("b"))
        .where(
            (F.col("a") == F.make_date("yr", F.lit(1), F.lit(1)))
            & (F.col("b") == F.make_date("yr", F.lit(12), F.lit(31)))
        )
        .select("yr")
    )
    return (
        covered_days(counts, years)
        .groupBy("yr")
        .agg(F.count_if(F.col("n_periods") != 48).alias("non_48_day_count"))
    )


def check_clock_changes(spine: DataFrame, day: str = "settlement_date_local") -> DataFrame:
    """Q9."""
    return clock_changes(spine, day).where(F.col("non_48_day_count") != 2)


# ---- Q10 --------------------------------------------------------------------
class LineageError(RuntimeError):
    """A feature reads a table that it must never read."""


def sources_of(df: DataFrame) -> set[str]:
    """Root paths, tables and named views behind a frame, at any depth of the analysed plan.

    The plan's own nodes are asked, in subqueries too; no file is listed. What was
    read from a written copy ends the lineage at that copy.
    """
    found: set[str] = set()
    waiting = [df._jdf.queryExecution().analyzed()]
    while waiting:
        node = waiting.pop()
        kind = node.nodeName()
        if kind == "SubqueryAlias":
            found.add(node.identifier().name())
        elif kind == "View":
            found.add(node.desc().identifier().table())
        elif kind.startswith("LogicalRelation"):
            relation = node.relation()
            if node.catalogTable().isDefined():
                found.add(node.catalogTable().get().identifier().table())
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                roots = relation.location().rootPaths()
                found.update(roots.apply(i).toString() for i in range(roots.size()))
        elif kind in ("HiveTableRelation", "DataSourceV2Relation", "StreamingRelation"):
            found.add(node.toString())
        for below in (node.children(), node.subqueries()):
            waiting.extend(below.apply(i) for i in range(below.size()))
    return found


def check_lineage(df: DataFrame, banned: Sequence[str]) -> DataFrame:
    """Q10: raises when a banned table feeds the frame, directly or not."""
    behind = sources_of(df)
    hits = sorted(
        b for b in banned for s in behind if s == b or f"/{b}/" in f"{s}/" or f"/{b}." in s
    )
    if hits:
        raise LineageError(f"features must not read {sorted(set(hits))}")
    return df


def status_of(name: str, violations: DataFrame, checked: DataFrame) -> DataFrame:
    """One row per assertion: rows checked and rows in violation.

    An assertion over an empty input proves nothing and does not count as passed.
    """
    return checked.agg(F.count(F.lit(1)).alias("rows_checked")).select(
        F.lit(name).alias("assertion"),
        "rows_checked",
        violations.agg(F.count(F.lit(1))).scalar().alias("violations"),
    ).withColumn("passed", (F.col("violations") == 0) & (F.col("rows_checked") > 0))
