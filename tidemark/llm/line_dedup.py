"""Near-duplicate lines across documents, by MinHash over character shingles.

A line is what stands between line breaks, without white space (0x20, 0x09 to
0x0D) around it, A-Z as a-z. Its set is its distinct shingles of ``SHINGLE``
characters. Four hash families deal the shingles to ``BINS`` bins each and keep
each bin's least hash, an empty bin taking that of the next one; band i is bin i
of all four. Lines that agree on a band are candidates, whole sets confirm them,
and components keep one line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.llm.exact_dedup import _LOWER, _UPPER
from tidemark.llm.linking import linked
from tidemark.llm.near_dedup import mark
from tidemark.llm.stars import joined_parts, stars
from tidemark.llm.workspace import Workspace, held

SHINGLE = 8
FAMILIES = 4
BINS = 16  # at similarity 0.8 all 16 bands miss with probability 2e-4
PERCENT = 80
SEEN = 200_000  # lines a task remembers to have met
_EMPTY = np.uint32(0xFFFFFFFF)
_REST = 7  # seeds the second half of a line's hash

_SEED = np.random.default_rng(13)
_FAMILY = _SEED.integers(0, 2**63, FAMILIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _SEED.integers(0, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_WHITE = " \t\n\x0b\x0c\r"


def lines_of(texts: DataFrame) -> DataFrame:
    """The columns of ``texts`` but the text, and (line_no, line) of each line that is not blank."""
    kept = [c for c in texts.columns if c != "text"]
    bare = F.btrim(F.col("raw"), F.lit(_WHITE))
    # a line of single bytes has no other letters to spare
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    line = F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))
    return (
        texts.select(*kept, F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
        .select(*kept, "line_no", line.alias("line"))
        .where("line != ''")
    )


def key(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def char_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of each line in order, and the first of each line.

    A line shorter than a shingle is one shingle.
    """
    codes = np.frombuffer(b"\n".join(lines).decode().encode("utf-32-le"), np.uint32)
    breaks = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], breaks + 1])
    ends = np.concatenate([breaks, [len(codes)]])
    h = codes.astype(np.uint64) + np.uint64(1)
    width = 1
    for step in _STEP:  # pairs, fours, eights
        h = h[:-width] * step + h[width:] if len(h) > width else h[:0]
        width *= 2
    h = textkit.mix(h)
    counts = np.maximum(ends - starts - SHINGLE + 1, 0)
    first = np.concatenate([[0], np.cumsum(np.maximum(counts, 1))])
    out = np.empty(first[-1], np.uint64)
    places = np.repeat(starts - first[:-1], np.maximum(counts, 1)) + np.arange(first[-1])
    long = np.repeat(counts > 0, np.maximum(counts, 1))
    out[long] = h[places[long]]
    for i in np.flatnonzero(counts == 0):
        out[first[i]] = np.frombuffer(key(lines[i]), np.uint64)[0]
    return out, first


def char_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    every, first = char_shingles([t.encode() for t in column.to_pylist()])
    return [np.unique(every[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def bands(every: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The band hashes of each line, one row a line."""
    n = len(first) - 1
    line = np.repeat(np.arange(n) * BINS, np.diff(first))
    out = np.arange(BINS, dtype=np.uint64) * np.ones((n, 1), np.uint64)
    for family in _FAMILY:
        g = every * family
        least = np.full(n * BINS, _EMPTY, np.uint32)
        np.minimum.at(least, line + (g >> np.uint64(60)).astype(np.int64), (g >> np.uint64(28)).astype(np.uint32))
        least = least.reshape(n, BINS)
        filled = least.astype(np.uint64)
        hollow = least == _EMPTY
        for step in range(1, BINS):
            if not hollow.any():
                break
            after = np.roll(least, -step, axis=1)
            take = hollow & (after != _EMPTY)
            filled[take] = after[take] + np.uint64(step << 32)
            hollow &= ~take
        out = textkit.mix(out * np.uint64(0x9E3779B97F4A7C15) + filled)
    return out.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bands of the lines of a task, a line again only when it was not met for long."""
    seen = np.empty(0, np.int64)
    for batch in batches:
        for part in textkit.groups(batch, "line"):
            nodes, at = np.unique(part.column("node").to_numpy(), return_index=True)
            at = at[~np.isin(nodes, seen, assume_unique=True)]
            seen = nodes if len(seen) > SEEN else np.union1d(seen, nodes)
            if not len(at):
                continue
            rows = part.take(pa.array(at))
            found = bands(*char_shingles([x.encode() for x in rows.column("line").to_pylist()]))
            ends = np.arange(0, len(at) * BINS + 1, BINS, dtype=np.int32)
            yield pa.record_batch(
                {
                    "node": rows.column("node"),
                    "bands": pa.ListArray.from_arrays(ends, pa.array(found.ravel())),
                }
            )
    textkit.give_back()


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, mark, line_no, group_size, keep_doc_id, keep_mark, keep_line_no, kept) of every line.

    Lines are linked if 100 * common >= ``PERCENT`` * all shingles of both; equal
    lines always. Of each component the line that stands first in the order
    (doc_id, mark, line_no), null doc_ids last, is kept; ``mark`` is a hash of
    the text that tells rows with one doc_id, or none, apart. line_no counts
    from 0. Blank lines are not listed and never dropped; a null or blank text
    has no rows. Rows equal in doc_id and text are the same document: each is
    listed, and counted. Other columns are not read. No rows give no rows.

    Each line counts once per task before anything is sent, so a line that is a
    third of all is sent a few times; its places are joined to one row.
    """
    ws = Workspace(docs.sparkSession, "lines")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string"), mark().alias("mark"))
    lines = lines_of(texts).withColumns({"node": F.xxhash64("line"), "rest": F.xxhash64(F.lit(_REST), "line")})
    banded = lines.select("node", "line").mapInArrow(_banded, "node long, bands array<long>")
    banded = ws.write(banded, "banded")
    found = ws.write(stars(banded.select(F.explode("bands").alias("bucket"), "node")), "found")
    ws.drop(banded)
    found = found.union(joined_parts(found).select(*found.columns))
    sizes = (
        found.groupBy("bucket")
        .agg(F.countDistinct("node").alias("size"), F.max("border").alias("crosses"))
        .where("size > 1")
    )
    leaders = F.array_distinct(F.array("first_node", "before_node")).alias("leaders")
    # first and before are all pairs of three nodes, unless a border between tasks parts them
    untested = ((F.col("size") > 3) | F.col("crosses")).alias("open")
    members = found.join(sizes, "bucket").select("bucket", "node", leaders, untested)
    members = ws.write(members.distinct(), "members")
    named = ws.write(members.select("node").distinct(), "named")
    pool = ws.write(
        lines.select("node", F.col("line").alias("text"))
        .join(held(named), "node", "left_semi")
        .groupBy("node").agg(F.min("text").alias("text")),
        "pool",
    )
    roots = linked(members, None, pool, char_sets, PERCENT, ws, kind="long")
    ws.drop(members, named, pool)
    owned = ws.write(
        lines.join(roots, "node", "left").select(
            "doc_id", "mark", "line_no",
            F.coalesce("root", "node").alias("root"),
            F.when(F.col("root").isNull(), F.col("rest")).otherwise(F.lit(0)).alias("rest"),
        ),
        "owned",
    )
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "line_no")
    groups = owned.groupBy("root", "rest").agg(F.count("*").alias("group_size"), F.min(place).alias("first"))
    first = F.col("first")
    here = (
        F.col("doc_id").eqNullSafe(first["doc_id"])
        & (F.col("mark") == first["mark"])
        & (F.col("line_no") == first["line_no"])
    )
    return owned.join(groups, ["root", "rest"]).select(
        "doc_id", "mark", "line_no", "group_size",
        first["doc_id"].alias("keep_doc_id"), first["mark"].alias("keep_mark"),
        first["line_no"].alias("keep_line_no"), here.alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, lines: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents with the lines of ``repeated_lines`` that are not kept taken out of their texts."""
    dropped = (
        lines.where("not kept")
        .groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_of"))
        .agg(F.collect_set("line_no").alias("_dropped"))
    )
    rows = docs.withColumn("_mark", mark())
    same = rows[doc_id].cast("long").eqNullSafe(dropped["_id"]) & (rows["_mark"] == dropped["_of"])
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_dropped", i))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return rows.join(dropped, same, "left").withColumn("text", text).select(*docs.columns)
