"""One run-log row per (run, source), written however the job ends."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "run_id string, source string, job string, window_from_utc timestamp, "
    "window_to_utc timestamp, started_at_utc timestamp, finished_at_utc timestamp, "
    "rows_read long, rows_written long, status string, error_class string, "
    "error_detail string"
)


class Run:
    """Counts a job reports while it runs."""

    def __init__(self):
        self.rows_read = 0
        self.rows_written = 0
        self.partial = False

    def counted(self, df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
        """The frame with a row counter that rides on its own action."""
        seen = Observation(name)
        return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def run_logged(
    spark: SparkSession,
    path: str,
    run_id: str,
    source: str,
    job: str,
    fn: Callable[[Run], None],
    window: tuple[datetime | None, datetime | None] = (None, None),
    now: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
) -> Run:
    """Run ``fn`` and append its outcome; a failure is logged and raised again."""
    run, started = Run(), now()
    status, error, detail = "success", None, None
    try:
        fn(run)
        status = "partial" if run.partial else "success"
    except Exception as exc:
        status, error, detail = "failed", type(exc).__name__, str(exc)[:2000]
        raise
    finally:
        row = (
            run_id, source, job, *window, started, now(),
            run.rows_read, run.rows_written, status, error, detail,
        )
        spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(path)
    return run
