"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. Each register keeps the
minimum of one exponential hash over the set, truncated to a power of ``BASE``;
registers of a union are the element-wise maxima. Documents that agree on a
band of registers are candidates. The joint likelihood of the three counts
(registers where one, the other or neither is larger) and the two known set
sizes says whether a similarity of the threshold is conceivable; what remains
is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.llm.linking import linked
from tidemark.llm.workspace import Workspace, held

REGISTERS = 128
BAND = 4  # registers of a band; at similarity 0.8 all 32 bands miss with probability 5e-8
BASE = 1.001
RATE = 20.0
TOP = 65_535
#: Log-likelihood by which a similarity below the threshold must win before a pair is dismissed.
DOUBT = 18.0
LEADERS = 3
#: Fewer equal registers than this have probability below 1e-9 at similarity 0.8 or more.
FEWEST_EQUAL = 73

_SEED = np.random.default_rng(7)
_MULTIPLY = (_SEED.integers(0, 2**31, REGISTERS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _SEED.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def registers(elements: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    low = (elements >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 512):
        block = low[at : at + 512, None] * _MULTIPLY
        block += _ADD
        np.minimum(least, block.min(axis=0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(">u2")


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.groups(batch, "text"):
                sets = textkit.shingle_sets(part.column("text"), k)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "mark": part.column("mark"),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "set_key": pa.array([_key(s) for s in sets], pa.binary()),
                        "registers": pa.array(
                            [registers(s).tobytes() if len(s) else None for s in sets], pa.binary()
                        ),
                    }
                )

    return run


def _keyed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.groups(batch, "text"):
                sets = textkit.shingle_sets(part.column("text"), k)
                yield pa.record_batch(
                    {
                        "node": pa.array([_key(s) for s in sets], pa.binary()),
                        "text": part.column("text"),
                    }
                )

    return run


def _key(elements: np.ndarray) -> bytes | None:
    """128 bits that name a set, whatever the order and number of its mentions."""
    if not len(elements):
        return None
    both = elements.sum(dtype=np.uint64), np.bitwise_xor.reduce(textkit.mix(elements))
    return np.array(both, np.uint64).tobytes()


def joint_estimate(
    more: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity, and by how much it beats the best one at or above the threshold.

    ``more`` and ``less`` count the registers where a is larger and smaller.
    """
    total = (size_a + size_b).astype(float)
    a, b = (size_a / total)[:, None], (size_b / total)[:, None]
    highest = np.minimum(a / b, b / a)
    grid = np.append(np.linspace(0, 1, 201), threshold)[None, :]
    at = np.minimum(grid, highest)

    def larger(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 1e-9, 1 - 1e-9)
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    up, down = larger(a - b * at), larger(b - a * at)
    same = np.clip(1 - up - down, 1e-9, 1)
    up, down = np.clip(up, 1e-9, 1), np.clip(down, 1e-9, 1)
    more, less = more[:, None], less[:, None]
    fit = more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(same)
    best = fit.argmax(axis=1)
    allowed = np.where(grid >= threshold, fit, -np.inf).max(axis=1)
    return at[np.arange(len(best)), best], fit.max(axis=1) - allowed


def _alike(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Which pairs have so many equal registers that the threshold is conceivable."""
    a, b = (np.frombuffer(b"".join(x), ">u2").reshape(-1, REGISTERS) for x in (first, second))
    return np.stack([(b == row).sum(axis=1) for row in a]) >= FEWEST_EQUAL


def _conceivable(threshold: float):
    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = matrix(batch.column("registers_a")), matrix(batch.column("registers_b"))
            _, behind = joint_estimate(
                (a > b).sum(axis=1), (a < b).sum(axis=1),
                batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), threshold,
            )
            yield batch.select(["u", "v"]).filter(pa.array(behind <= DOUBT))

    return run


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, mark) of every row.

    Two documents are linked if 100 * shared shingles >= percent * all shingles
    of both. component_id is the least doc_id that links reach; kept is the one
    document that bears it. A text of fewer words than a shingle is one shingle;
    a null, empty or blank text has none, is linked with nothing and is its own
    component. A null doc_id links like any other row, but names no component
    unless all of its component's are null. Of different texts with one doc_id,
    or none, in one component the one with the least ``mark``, a hash of the
    text, is kept; rows equal in both are the same document and stay or go
    together. Other columns are not read. No rows give no rows.

    Documents with equal sets are one node from the start, so a group of copies
    costs one candidate. Inside a bucket each node is compared with a few
    leaders, and confirmed links merge nodes. Buckets whose nodes are then still
    in several components are settled in blocks: the nodes outside the largest
    component against all, counting common shingles, and reporting one link of a
    node to a component. So every pair that shares a band is confirmed, refuted
    or already connected, and no list of all pairs of a group is made.
    """
    ws = Workspace(docs.sparkSession, "near")
    texts = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string"), mark().alias("mark")
    )
    signed = ws.write(
        texts.mapInArrow(
            _signed(shingle_words),
            "doc_id long, mark long, n_shingles long, set_key binary, registers binary",
        ),
        "signed",
    )
    sets = ws.write(
        signed.where("set_key is not null")
        .select(F.col("set_key").alias("node"), F.col("n_shingles").alias("n"), "registers")
        .distinct(),
        "sets",
    )
    bands = sets.select(
        "node",
        F.explode(
            F.array(
                *(
                    F.xxhash64(F.lit(i), F.substring("registers", 2 * BAND * i + 1, 2 * BAND))
                    for i in range(REGISTERS // BAND)
                )
            )
        ).alias("bucket"),
    )
    leaders = [
        F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node"))["node"]
        for i in range(LEADERS)
    ]
    shared = (
        bands.groupBy("bucket")
        .agg(F.count("*").alias("size"), F.array_distinct(F.array(*leaders)).alias("leaders"))
        .where("size > 1")
    )
    # where at most one node is no leader, every pair is tested
    untested = (F.col("size") > F.size("leaders") + 1).alias("open")
    members = bands.join(shared, "bucket").select("bucket", "node", "leaders", untested)
    members = ws.write(members, "members")
    named = ws.write(members.select("node").distinct(), "named")
    pool = ws.write(
        texts.mapInArrow(_keyed(shingle_words), "node binary, text string")
        .join(held(named), "node", "left_semi")
        .groupBy("node")
        .agg(F.min("text").alias("text")),
        "pool",
    )
    likely = lambda rows: rows.mapInArrow(
        _conceivable(percent / 100), "u binary, v binary"
    )
    roots = linked(
        members, sets, pool, partial(textkit.shingle_sets, k=shingle_words), percent, ws, likely, _alike
    )
    ws.drop(members, sets, named, pool)
    owned = ws.write(
        signed.select("doc_id", "mark", "n_shingles", F.col("set_key").alias("node"))
        .join(roots, "node", "left")
        .select("doc_id", "mark", "n_shingles", F.coalesce("root", "node").alias("root")),
        "owned",
    )
    ws.drop(signed)
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    least = owned.where("root is not null").groupBy("root").agg(F.min(first).alias("first"))
    alone = F.col("root").isNull()
    return owned.join(least, "root", "left").select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))).alias("kept"),
        "mark",
    )


def mark() -> Column:
    """Tells the texts of rows with one doc_id, or none, apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
