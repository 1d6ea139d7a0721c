"""Intermediate tables of one run, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_dir

# the files of a query's shuffles go when it has ended, not when the driver next collects garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_ROWS = 1_000_000  # keys of a few bytes that every executor may hold


def held(keys: DataFrame) -> DataFrame:
    """A table of keys, to be broadcast if its counted rows are few; a plain side of a join beyond.

    It spares the texts on the other side a shuffle, and changes no result.
    """
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


class Workspace:
    """Tables written once and read by several later steps.

    They lie under ``spark.checkpoint.dir``, so what follows does not depend on
    the executors that computed them, and the lineage ends there. The shuffles
    of a table are deleted as soon as it is stored; a task that misses one makes
    it again. ``drop`` deletes a table that nothing will read again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_dir(spark, name)
        self._count = 0

    def write(self, df: DataFrame, step: str) -> DataFrame:
        """The frame as a stored table."""
        self._count += 1
        path = f"{self.base}/{self._count:03d}-{step}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._workspace_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._workspace_path)
            path.getFileSystem(conf).delete(path, True)
