"""T-4: landing as a stream of files, with the same change rule as the batch."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.versions import insert_if_changed, with_landing_ids
from tidemark.sources.tables import exists

ID_BITS = 40  # of a landing id, for the rows of one batch; the batch number stands above


def land_batch(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    keys: Sequence[str],
    batch_id: int,
    time: str = "sp_start_utc",
) -> int:
    """Append the changed rows of one micro-batch; returns how many there were.

    Each batch owns a folder of days, written in overwrite mode, and looks only
    at the folders of earlier batches; a batch that is replayed after a failure
    rewrites the same rows.
    """
    shape = batch.withColumn("day", F.to_date(time)).withColumn("batch_id", F.lit(0).cast("long"))
    if "landing_id" not in batch.columns:
        shape = shape.withColumn("landing_id", F.lit(0).cast("long"))
    stored = None
    if exists(spark, path):
        span = batch.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
        earlier = [f for f in live_folders(spark, path, F.lit(span["lo"]), F.lit(span["hi"])) if _number(f) < batch_id]
        if earlier:
            held = spark.read.schema(shape.schema).option("basePath", path).parquet(*earlier)
            stored = held.drop("batch_id")
    fresh = batch if stored is None else insert_if_changed(stored, batch, keys, time)
    if "landing_id" not in batch.columns:
        fresh = with_landing_ids(fresh, F.lit(batch_id << ID_BITS), keys)
    target, seen = f"{path}/batch_id={batch_id}", Observation(f"landed-{uuid.uuid4().hex}")
    dated = fresh.withColumn("day", F.to_date(time)).observe(seen, F.count(F.lit(1)).alias("n"))
    # Replace the whole folder: a replay may have fewer days than the failed try.
    dated.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        "day"
    ).parquet(target)
    _zone(spark, path, batch_id, shape, time)
    return seen.get["n"]


# ---- zone map -----------------------------------------------------------------
_ZONE = "batch_id long, day date, least timestamp, greatest timestamp, rows long, replaces array<long>"


def _zone(
    spark: SparkSession, path: str, batch_id: int, shape: DataFrame, time: str, replaces: Sequence[int] = ()
) -> None:
    """Write what a stored batch holds: the least and greatest period of each of its days.

    The map has a folder a batch, so a replay rewrites its own; a batch without
    rows has one row without a day. A compacted batch names those it replaces.
    """
    folder = f"{path}/batch_id={batch_id}"
    held = spark.read.schema(shape.schema).option("basePath", path).parquet(folder)
    gone = F.array(*[F.lit(i).cast("long") for i in replaces]).cast("array<long>")
    zones = held.groupBy("day").agg(
        F.min(time).alias("least"), F.max(time).alias("greatest"), F.count(F.lit(1)).alias("rows")
    )
    one = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"), gone.alias("replaces"))
    one.join(zones, how="left").select(
        "batch_id", "day", "least", "greatest", "rows", "replaces"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/_zones/zone-{batch_id}")  # a row a day


def _zones(spark: SparkSession, path: str) -> DataFrame | None:
    folder = f"{path}/_zones"
    return spark.read.schema(_ZONE).parquet(f"{folder}/*") if exists(spark, folder) else None


def live_folders(
    spark: SparkSession, path: str, since: Column | None = None, until: Column | None = None
) -> list[str]:
    """The folders of days to read for periods from ``since`` until ``until``, by the zone map.

    Batches that a compaction replaced are left out; a batch without zones, of
    which nothing is known, is read whole. Only names come to the driver: those
    of the days in the bounds.
    """
    zones, batches = _zones(spark, path), _batch_ids(spark, path)
    own, gone = _known(zones)
    begun = _begun(spark, path) - own  # of a compaction that never ended
    whole = [f"{path}/batch_id={i}" for i in batches if i not in own | gone | begun]
    if zones is None:
        return whole
    zones = _unpruned(spark, path, zones)
    inside = F.col("day").isNotNull()
    inside = inside & (F.col("greatest") >= since) if since is not None else inside
    inside = inside & (F.col("least") <= until) if until is not None else inside
    days = zones.where(inside).select("batch_id", F.col("day").cast("string").alias("day")).distinct().collect()
    return sorted(f"{path}/batch_id={r['batch_id']}/day={r['day']}" for r in days if r["batch_id"] not in gone) + whole


def _known(zones: DataFrame | None) -> tuple[set[int], set[int]]:
    """The batches that have zones, and those that a compaction replaced."""
    if zones is None:
        return set(), set()
    rows = zones.select("batch_id", "replaces").distinct().collect()  # a row a batch
    return {r["batch_id"] for r in rows}, {i for r in rows for i in r["replaces"]}


def _number(folder: str) -> int:
    return int(folder.split("batch_id=")[1].split("/")[0])


def compact(spark: SparkSession, path: str, time: str = "sp_start_utc") -> int:
    """All live batches as one new batch, landing ids kept; returns how many it replaced.

    A mark is set first, and a marked batch counts only once its zones are
    written, which name those it replaces; from then on nothing reads them, and
    they are deleted. What a failure leaves before or after that is deleted by
    the next compaction.
    """
    own, gone = _known(_zones(spark, path))
    stale = gone | (_begun(spark, path) - own)
    _delete_pruned(spark, path)
    _delete(spark, [f"{path}/batch_id={i}" for i in _batch_ids(spark, path) if i in stale])
    live = [i for i in _batch_ids(spark, path) if i not in stale]
    days = live_folders(spark, path)
    if len(live) < 2 or not days:
        return 0
    number = max([*live, *own, *stale]) + 1
    _mark(spark, f"{path}/{_BEGUN}{number}")
    folders = [f"{path}/batch_id={i}" for i in live]
    rows = spark.read.option("basePath", path).parquet(*days).drop("batch_id")
    (
        rows.repartition("day").write.mode("overwrite")
        .option("partitionOverwriteMode", "static").partitionBy("day").parquet(f"{path}/batch_id={number}")
    )
    _zone(spark, path, number, rows.withColumn("batch_id", F.lit(0).cast("long")), time, live)
    _delete(spark, [*folders, f"{path}/{_BEGUN}{number}"])
    return len(live)


# ---- retention ----------------------------------------------------------------
_PRUNED = "batch_id long, day date, rows long, least timestamp, greatest timestamp, cutoff timestamp, pruned_at_utc timestamp"


class RetentionError(RuntimeError):
    """Rows may not go, since nothing else holds what they say."""


def expired_days(spark: SparkSession, path: str, cutoff: Column) -> DataFrame:
    """The day folders all of whose periods lie before the cutoff, one row each, by the zone map.

    A batch without zones is not known to be old, so none of it is named.
    """
    zones = _zones(spark, path)
    if zones is None:
        return spark.createDataFrame([], _PRUNED).select("batch_id", "day", "rows", "least", "greatest")
    _, gone = _known(zones)
    old = _unpruned(spark, path, zones).where(F.col("day").isNotNull() & (F.col("greatest") < cutoff))
    return old.where(~F.col("batch_id").isin(list(gone))).select("batch_id", "day", "rows", "least", "greatest")


def prune_days(
    spark: SparkSession,
    path: str,
    cutoff: Column,
    as_of: Column,
    mart: DataFrame | None = None,
    keys: Sequence[str] = ("sp_start_utc",),
) -> DataFrame:
    """Drop the expired day folders; returns a row for each that went.

    With a ``mart`` nothing goes unless it holds every key of the rows to go.
    The manifest of what goes is stored before a folder is deleted, and readers
    heed it from then on, so a failure between leaves folders that nobody reads
    and the next run deletes. A day with one period from the cutoff on stays
    whole. Old periods that land again stand in a new batch.
    """
    going = expired_days(spark, path, cutoff)
    # names of folders, as everywhere in the zone map
    days = [f"{path}/batch_id={r['batch_id']}/day={r['day']}" for r in going.select("batch_id", "day").collect()]
    if days and mart is not None:
        rows = spark.read.option("basePath", path).parquet(*days).select(*keys).distinct()
        bare = rows.join(mart.select(*keys), list(keys), "left_anti").count()
        if bare:
            raise RetentionError(f"the mart lacks {bare} of the keys to delete; nothing is pruned")
    if days:
        manifest = going.select(*going.columns, cutoff.alias("cutoff"), as_of.alias("pruned_at_utc"))
        manifest.coalesce(1).write.mode("append").parquet(f"{path}/_pruned")  # a row a folder
    _delete_pruned(spark, path)
    return pruned(spark, path).where(F.col("pruned_at_utc") == as_of)


def pruned(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of every day folder that retention has dropped."""
    folder = f"{path}/_pruned"
    if not exists(spark, folder):
        return spark.createDataFrame([], _PRUNED)
    return spark.read.schema(_PRUNED).parquet(folder)


def _unpruned(spark: SparkSession, path: str, zones: DataFrame) -> DataFrame:
    if not exists(spark, f"{path}/_pruned"):
        return zones
    return zones.join(pruned(spark, path).select("batch_id", "day"), ["batch_id", "day"], "left_anti")


def _delete_pruned(spark: SparkSession, path: str) -> None:
    """Delete the folders of the manifest that still stand, those of a failed run too."""
    if not exists(spark, f"{path}/_pruned"):
        return
    held = [(i, n[len("day="):]) for i in _batch_ids(spark, path)
            for n in _names(spark, f"{path}/batch_id={i}") if n.startswith("day=")]
    if not held:
        return
    named = pruned(spark, path).select("batch_id", F.col("day").cast("string").alias("day")).distinct()
    standing = named.join(spark.createDataFrame(held, "batch_id long, day string"), ["batch_id", "day"]).collect()
    _delete(spark, [f"{path}/batch_id={r['batch_id']}/day={r['day']}" for r in standing])


_BEGUN = "_compacting-"


def _mark(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def _begun(spark: SparkSession, path: str) -> set[int]:
    """The batches of compactions that have begun and not ended."""
    return {int(n[len(_BEGUN):]) for n in _names(spark, path) if n.startswith(_BEGUN)}


def _delete(spark: SparkSession, folders: Sequence[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)]


def _batch_ids(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in _names(spark, path) if n.startswith("batch_id="))


def next_batch_id(spark: SparkSession, path: str) -> int:
    """The number after the last batch that was stored."""
    return max(_batch_ids(spark, path), default=-1) + 1 if exists(spark, path) else 0


def land_stream(
    spark: SparkSession,
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    time: str = "sp_start_utc",
) -> None:
    """Drain what has arrived, one ordered micro-batch after another."""
    query = (
        stream.writeStream.foreachBatch(
            lambda df, i: land_batch(spark, path, df, keys, i, time) and None
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_landing(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """The landed rows; with ``since`` those of days whose greatest period reaches it."""
    folders = live_folders(spark, path, since)
    whole = spark.read.option("basePath", path)
    if folders:
        return whole.parquet(*folders).drop("batch_id", "day")
    return whole.parquet(path).drop("batch_id", "day").limit(0)
