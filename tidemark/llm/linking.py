"""From buckets of candidates to components of confirmed links.

Inside a bucket each node is compared with a few leaders, and confirmed links
merge nodes. Buckets whose nodes are then still in several components are
settled in blocks: the nodes outside the largest component against all, counting
common elements, and reporting one link of a node to a component. So every pair
that shares a bucket is confirmed, refuted or already connected, and no list of
all pairs of a group is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.llm.components import components
from tidemark.llm.workspace import Workspace

BLOCK = 512  # nodes on either side of a block
LEAST_BLOCK = 16
PACK = 4096  # rows of the blocks that are settled together, about
PACK_BYTES = 32 << 20  # and bytes of their texts
MANY = 16 * PACK  # rows of blocks above which an eighth of the buckets is settled first

Sets = Callable[[pa.Array], list[np.ndarray]]


def linked(
    members: DataFrame,
    sets: DataFrame | None,
    pool: DataFrame,
    sets_of: Sets,
    percent: int,
    ws: Workspace,
    likely: Callable[[DataFrame], DataFrame] | None = None,
    alike: Callable[[list[bytes], list[bytes]], np.ndarray] | None = None,
    kind: str = "binary",
) -> DataFrame:
    """(node, root) of the nodes that confirmed links connect; ``kind`` is the type of nodes.

    ``members`` has (bucket, node, leaders, open): an array of nodes of the
    bucket to compare with, and whether that leaves pairs of the bucket
    untested. ``sets`` has (node, n, registers), the size of
    a node's set and a sketch; ``pool`` has (node, text), from which
    ``sets_of`` makes the sorted hashes of the whole sets. Two nodes are linked
    if 100 * common >= percent * all elements. ``likely`` may dismiss pairs
    (u, v, n_a, n_b, registers_a, registers_b) and ``alike`` pairs of sketches
    that cannot be linked; without ``sets`` there are no sketches.
    """
    stars = (
        members.select("node", F.explode("leaders").alias("leader"))
        .where("node != leader")
        .select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v"))
        .distinct()
    )
    found = ws.write(_verified(stars, sets, pool, sets_of, percent, likely, kind), "verified")
    roots = components(found, ws)
    ws.drop(found)
    opened = members.where("open").select("bucket", "node")
    rows = _unsettled(opened, roots, ws)
    if _copies(rows) > MANY:
        # most pairs share many buckets: what an eighth of the buckets connects, the rest need not test
        eighth = F.pmod(F.xxhash64(F.lit(5), "bucket"), F.lit(8)) == 0
        roots = _settle(rows.where(eighth), roots, sets, pool, sets_of, percent, alike, ws, kind)
        ws.drop(rows)
        rows = _unsettled(opened.where(~eighth), roots, ws)
    return _settle(rows, roots, sets, pool, sets_of, percent, alike, ws, kind)


def _unsettled(opened: DataFrame, roots: DataFrame, ws: Workspace) -> DataFrame:
    """The nodes of the buckets whose nodes are in several components."""
    tagged = ws.write(
        opened.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")),
        "tagged",
    )
    split = (
        tagged.groupBy("bucket", "root").agg(F.count("*").alias("c"))
        .groupBy("bucket").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("top"))
        .where("size > top.c")
    )
    rows = ws.write(
        tagged.join(split, "bucket").select(
            "bucket", "node", "root", (F.col("root") != F.col("top.root")).alias("outside"), "size",
            (F.col("size") - F.col("top.c")).alias("others"),
        ),
        "unsettled",
    )
    ws.drop(tagged)
    return rows


def _blocks(n: str, block: int) -> Column:
    return F.ceil(F.col(n) / block).cast("int")


def _copied(block: int) -> Column:
    """To how many blocks a node goes: all that ask, and if it asks itself, all."""
    return _blocks("others", block) + F.when(F.col("outside"), _blocks("size", block)).otherwise(0)


def _copies(rows: DataFrame) -> int:
    return rows.agg(F.sum(_copied(BLOCK))).first()[0] or 0


def _settle(rows, roots, sets, pool, sets_of, percent, alike, ws, kind) -> DataFrame:
    """The components after the links between the nodes of every bucket's components.

    Blocks are dealt as keys; a group holds about PACK rows of them and about
    PACK_BYTES of texts, each text once.
    """
    sized = rows.join(pool.select("node", F.octet_length("text").alias("bytes")), "node")
    n, mean = sized.agg(F.count("*"), F.avg("bytes")).first()
    if not n:
        return roots
    block = int(max(LEAST_BLOCK, min(BLOCK, PACK_BYTES // (2 * max(1, mean)))))
    copies, volume = sized.agg(F.sum(_copied(block)), F.sum(_copied(block) * F.col("bytes"))).first()
    n_groups = 1 + max(copies // PACK, volume // PACK_BYTES)
    own = F.xxhash64(F.lit(99), "node")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), _blocks(n, block) - 1))
    grid = (
        rows.withColumn("j", F.pmod(own, _blocks("size", block)).cast("int"))
        .withColumn("i", all_of("others")).withColumn("asks", F.lit(False))
        .unionByName(
            rows.where("outside").withColumn("i", F.pmod(own, _blocks("others", block)).cast("int"))
            .withColumn("j", all_of("size")).withColumn("asks", F.lit(True))
        )
    )
    # most blocks are small: many of them make one group, each still by itself
    number = F.xxhash64("bucket", "i", "j")
    grid = grid.select(
        F.pmod(number, F.lit(n_groups)).alias("group"), number.alias("block"), "asks", "node", "root"
    )
    texts = grid.select(F.col("group").alias("of_group"), F.col("node").alias("of")).distinct()
    texts = texts.join(pool.withColumnRenamed("node", "of"), "of")
    if sets:
        texts = texts.join(sets.select(F.col("node").alias("of"), "registers"), "of")
    else:
        texts = texts.withColumn("registers", F.lit(None).cast("binary"))
    links = (
        grid.groupBy("group")
        .cogroup(texts.select("of_group", F.col("of").alias("node"), "text", "registers").groupBy("of_group"))
        .applyInArrow(_settled(sets_of, percent, alike), f"u {kind}, v {kind}")
    )
    links = ws.write(links.distinct(), "links")
    found = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(links.union(found), ws)


def _verified(
    pairs: DataFrame, sets: DataFrame | None, pool: DataFrame, sets_of: Sets, percent: int, likely, kind: str
) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def side(table: DataFrame, node: str, tag: str) -> DataFrame:
        rest = [c for c in table.columns if c != "node"]
        return table.select(F.col("node").alias(node), *(F.col(c).alias(f"{c}_{tag}") for c in rest))

    if sets:
        pairs = likely(
            pairs.join(side(sets, "u", "a"), "u").join(side(sets, "v", "b"), "v")
            .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
            .select("u", "v", "n_a", "n_b", "registers_a", "registers_b")
        )
    return (
        pairs.join(side(pool, "u", "a"), "u").join(side(pool, "v", "b"), "v")
        .select("u", "v", "text_a", "text_b")
        .mapInArrow(_confirmed(sets_of, percent), f"u {kind}, v {kind}")
    )


def _confirmed(sets_of: Sets, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.groups(batch, "text_a", "text_b"):
                first, second = sets_of(part.column("text_a")), sets_of(part.column("text_b"))
                both = list(zip(first, second, strict=True))
                common = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in both])
                sizes = np.array([len(a) + len(b) for a, b in both])
                kept = 100 * common >= percent * (sizes - common)
                yield part.select(["u", "v"]).filter(pa.array(kept))

    return run


def _settled(sets_of: Sets, percent: int, alike):
    """Links between nodes outside a bucket's largest component and all, block by block."""

    def links(a, b, nodes, roots, sets, registers) -> list[tuple]:
        size_a, size_b = (np.array([len(sets[i]) for i in x]) for x in (a, b))
        small, large = np.minimum(size_a[:, None], size_b), np.maximum(size_a[:, None], size_b)
        wanted = (100 * small >= percent * large) & (roots[a][:, None] != roots[b])
        if alike is not None:
            wanted &= alike([registers[i] for i in a], [registers[i] for i in b])
        if not wanted.any():
            return []
        common = _common([sets[i] for i in a], [sets[i] for i in b], wanted)
        found = wanted & (100 * common >= percent * (size_a[:, None] + size_b - common))
        # one link of a node to each component is enough
        return [
            (nodes[a[x]], nodes[b[y]])
            for x in np.flatnonzero(found.any(axis=1))
            for y in {roots[b[y]]: y for y in np.flatnonzero(found[x])}.values()
        ]

    def run(rows: pa.Table, texts: pa.Table) -> pa.Table:
        kind = rows.schema.field("node").type
        nodes = texts.column("node").to_pylist()
        places = {node: i for i, node in enumerate(nodes)}
        row_of = np.array([places[n] for n in rows.column("node").to_pylist()], np.int64)
        sets = sets_of(texts.column("text").combine_chunks()) if nodes else []
        registers = texts.column("registers").to_pylist()
        _, root = np.unique(np.array(rows.column("root").to_pylist(), object), return_inverse=True)
        roots = np.zeros(len(nodes), np.int64)
        roots[row_of] = root
        block, asks = rows.column("block").to_numpy(), rows.column("asks").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        out: list[tuple] = []
        for at in np.split(order, cuts):
            a, b = row_of[at[asks[at]]], row_of[at[~asks[at]]]
            if len(a) and len(b):
                out += links(a, b, nodes, roots, sets, registers)
        textkit.give_back()
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.table({"u": pa.array(u, kind), "v": pa.array(v, kind)})

    return run


def _common(sets_a: list, sets_b: list, wanted: np.ndarray) -> np.ndarray:
    """The sizes of the intersections, where wanted."""
    out = np.zeros(wanted.shape, np.int64)
    pairs = np.argwhere(wanted)
    if len(pairs) <= 2000:
        for a, b in pairs:
            out[a, b] = len(np.intersect1d(sets_a[a], sets_b[b], assume_unique=True))
        return out
    both = np.intersect1d(np.unique(np.concatenate(sets_a)), np.unique(np.concatenate(sets_b)))
    for at in range(0, len(both), 2048):
        few = both[at : at + 2048]
        dense = []
        for sets in (sets_a, sets_b):
            has = np.zeros((len(sets), len(few)), np.float32)
            for row, s in enumerate(sets):
                inside = np.intersect1d(few, s, assume_unique=True)
                has[row, np.searchsorted(few, inside)] = 1
            dense.append(has)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out
