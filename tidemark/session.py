"""Session settings the operators rely on, and where scratch tables may live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the two runtime settings that change results, and leave sizing alone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tidemark"):
    """A session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tidemark-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_scratch: list[str] = []  # folders this process has named


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders named so far; for the end of a job, when nothing reads them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        removed += path.getFileSystem(conf).delete(path, True)
    return removed


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder on the storage the cluster shares.

    The cluster names it in ``spark.checkpoint.dir``. Only where nothing is
    named, as in a local test, is a temporary folder chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder.

    For a result that several later steps read: it is computed once, and what
    follows does not depend on the executors that computed it.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
