"""Pairs of the rows of a bucket with its first row and the row before, in one shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fresh(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one above; the first does."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
    return out


def _streamed(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the open bucket: its first row, the last row of the node before, and the last row
        carried = None
        head = None  # the bucket and the node with which the task begins
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if carried is not None:
                table = pa.concat_tables([carried, table])
            table = table.combine_chunks()
            table = table.filter(pa.array(np.logical_or.reduce([_fresh(table.column(c)) for c in columns])))
            bucket, node = table.column("bucket").to_numpy(), table.column("node").to_numpy()
            places = np.arange(len(bucket))
            opens = _fresh(table.column("bucket"))
            first = np.maximum.accumulate(np.where(opens, places, 0))
            turns = opens | _fresh(table.column("node"))
            turn = np.maximum.accumulate(np.where(turns, places, 0))  # the first row of the same node
            head = head or (bucket[0], node[0])
            border = (bucket == head[0]) & (node == head[1])  # the bucket may have begun in another task
            starts = np.flatnonzero(opens)
            several = np.repeat(np.add.reduceat(turns, starts) > 1, np.diff(np.append(starts, len(bucket))))
            at = np.flatnonzero(border | several & ((turn > first) | opens))
            group = np.cumsum(turns)
            many = group - group[first] >= 3  # what is carried has three nodes if there were as many
            yield _pairs(table, columns, at, first[at], np.maximum(turn[at] - 1, first[at]), border[at], many[at])
            end = len(bucket) - 1
            carried = table.take(sorted({first[end], max(turn[end] - 1, first[end]), end}))
        if carried is not None:  # and may go on in another one
            end, none = np.array([len(carried) - 1]), np.array([0])
            yield _pairs(carried.combine_chunks(), columns, end, none, none, np.array([True]), np.array([False]))

    return run


def _pairs(table: pa.Table, columns: list[str], at, first, before, border, many) -> pa.RecordBatch:
    out = {c: table.column(c).take(at) for c in columns}
    out |= {f"first_{c}": table.column(c).take(first) for c in columns if c != "bucket"}
    out |= {f"before_{c}": table.column(c).take(before) for c in columns if c != "bucket"}
    table = pa.table(out | {"border": pa.array(border), "many": pa.array(many)}).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) for c in table.columns], names=table.column_names)


def stars(rows: DataFrame) -> DataFrame:
    """The rows (bucket, node, ...) of buckets of several nodes, each with two others of its bucket.

    The other columns follow, as do ``first_`` and ``before_`` versions of all but
    the bucket: the first row of the bucket and the last row of the node before in
    the order of all columns (the bucket's first row for its first node). bucket
    and node are longs; of rows equal in all columns one counts. Each row of a
    node is paired, but of the bucket's first node its first row stands for all.
    Rows are dealt in ranges of (bucket, node), so a bucket of a third of all rows
    is spread over tasks, each of which streams its part with three rows in
    memory. Where a bucket crosses a border its parts have first rows of their
    own; the rows of a part's first node are then paired with the bucket's first
    row. ``border`` marks the rows of the first node of a task and its last row;
    their bucket may have one node only. ``many`` marks rows of the fourth and
    later nodes of a bucket in a task: without them, and without a border, first
    and before are all pairs of the bucket. A row may appear twice. The input is
    read twice, once to find the ranges.
    """
    columns = ["bucket", "node", *(c for c in rows.columns if c not in ("bucket", "node"))]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType(
        [T.StructField(c, kinds[c]) for c in columns]
        + [T.StructField(f"{p}_{c}", kinds[c]) for p in ("first", "before") for c in columns if c != "bucket"]
        + [T.StructField(c, T.BooleanType()) for c in ("border", "many")]
    )
    return (
        rows.select(*columns)
        .repartitionByRange("bucket", "node")
        .sortWithinPartitions(*columns)
        .mapInArrow(_streamed(columns), schema)
    )


def joined_parts(found: DataFrame) -> DataFrame:
    """Rows that pair the rows of the first node of a bucket's parts with the first of all.

    Every part of a bucket that crosses a border has a row at it, so the rows of
    one node and one row more a task are all that is read.
    """
    columns = [
        c for c in found.columns if not c.startswith(("first_", "before_")) and c not in ("bucket", "border", "many")
    ]
    found = found.where("border")
    heads = found.groupBy("bucket").agg(
        F.min_by(F.struct(*(f"first_{c}" for c in columns)), "first_node").alias("head"),
        F.max("first_node").alias("last"),
    )
    crossing = heads.where("last != head.first_node").drop("last")
    parts = (
        found.select("bucket", *(F.col(f"first_{c}").alias(c) for c in columns))
        .union(found.where("node = first_node").select("bucket", *columns))
        .distinct()
    )
    return (
        parts.join(crossing, "bucket")
        .where("node != head.first_node")
        .select(
            "bucket", *columns,
            *(F.col(f"head.first_{c}") for c in columns),
            *(F.col(f"head.first_{c}").alias(f"before_{c}") for c in columns),
            F.lit(True).alias("border"), F.lit(False).alias("many"),
        )
    )
