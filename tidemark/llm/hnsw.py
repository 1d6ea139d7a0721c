"""Nearest neighbours by inner product: a navigable small-world graph per shard.

Vectors are dealt to shards of about ``SHARD`` rows by a hash. Each shard is one
hierarchical graph, kept as flat arrays: for every layer the places of
neighbours, ``-1`` where there are fewer. Inner products are no metric, so the
graph is built over vectors with one more component that gives all of a shard
one length; a query has 0 there, and the order by inner product is the order by
distance. Equal vectors of a shard are one node. Each block of queries is
searched in each shard, and the shards' results are merged.
"""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.workspace import Workspace

SHARD = 8192  # rows of a shard
BLOCK = 4096  # queries searched together
LINKS = 12  # neighbours of a node on upper layers, twice as many on the lowest
BUILD = 64  # candidates kept while a node is inserted
SEARCH = 96  # candidates kept while a query is answered


class Graph:
    """A hierarchical navigable small-world graph over the distinct vectors of a shard."""

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        self.vectors = vectors.astype(np.float64)
        norms = (self.vectors**2).sum(axis=1)
        rest = np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))
        self.lifted = np.concatenate([self.vectors, rest[:, None]], axis=1).astype(np.float32)
        n = len(vectors)
        chance = np.random.default_rng(seed).random(n)
        self.levels = np.minimum(-np.log(1 - chance) / np.log(LINKS), 12).astype(np.int8)
        self.layers = [
            np.full((n, 2 * LINKS if level == 0 else LINKS), -1, np.int32)
            for level in range(int(self.levels.max(initial=0)) + 1)
        ]
        self.entry = -1
        self._seen = np.zeros(n, np.int64)
        self._turn = 0
        for node in range(n):
            self._insert(node)

    @classmethod
    def stored(cls, vectors, levels, layers, entry) -> Graph:
        """From its arrays."""
        graph = cls.__new__(cls)
        graph.vectors, graph.levels, graph.layers, graph.entry = vectors, levels, layers, entry
        graph.lifted = vectors.astype(np.float32)
        graph._seen, graph._turn = np.zeros(len(vectors), np.int64), 0
        return graph

    def _near(self, q: np.ndarray, entries: list[int], keep: int, layer: int) -> list[tuple[float, int]]:
        """About the ``keep`` most similar nodes of a layer, most similar first."""
        links, vectors, seen = self.layers[layer], self.lifted, self._seen
        self._turn += 1
        turn = self._turn
        seen[entries] = turn
        sims = (vectors[entries] @ q).tolist()
        best = []  # a heap with the least similar first
        ahead = []
        for s, e in zip(sims, entries, strict=True):
            heappush(best, (s, e))
            heappush(ahead, (-s, e))
        while len(best) > keep:
            heappop(best)
        while ahead:
            s, node = heappop(ahead)
            if -s < best[0][0] and len(best) >= keep:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            for s, other in zip((vectors[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < keep:
                    heappush(best, (s, other))
                    heappush(ahead, (-s, other))
                elif s > best[0][0]:
                    heapreplace(best, (s, other))
                    heappush(ahead, (-s, other))
        return sorted(best, reverse=True)

    def _descend(self, q: np.ndarray, to: int) -> int:
        """The node reached greedily on the layers above ``to``."""
        node = self.entry
        for layer in range(int(self.levels[self.entry]), to, -1):
            node = self._near(q, [node], 1, layer)[0][1]
        return node

    def _chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: none nearer to a chosen one than to the node."""
        places = [p for _, p in found]
        among = self.lifted[places] @ self.lifted[places].T
        kept: list[int] = []
        for i, (s, _) in enumerate(found):
            if len(kept) == most:
                break
            if not kept or s > among[i, kept].max():
                kept.append(i)
        spare = iter([i for i in range(len(found)) if i not in set(kept)])
        while len(kept) < min(most, len(found)):
            kept.append(next(spare))
        return [places[i] for i in kept]

    def _insert(self, node: int) -> None:
        level = int(self.levels[node])
        if self.entry < 0:
            self.entry = node
            return
        q, top = self.lifted[node], int(self.levels[self.entry])
        entries = [self._descend(q, min(level, top))]
        for layer in range(min(level, top), -1, -1):
            found = self._near(q, entries, BUILD, layer)
            links = self.layers[layer]
            for other in (chosen := self._chosen(found, LINKS)):
                free = np.flatnonzero(links[other] < 0)
                if len(free):
                    links[other, free[0]] = node
                else:
                    all_ = np.append(links[other], node)
                    sims = (self.lifted[all_] @ self.lifted[other]).tolist()
                    ranked = sorted(zip(sims, all_.tolist(), strict=True), reverse=True)
                    kept = self._chosen(ranked, links.shape[1])
                    links[other] = -1
                    links[other, : len(kept)] = kept
            links[node, : len(chosen)] = chosen
            entries = [p for _, p in found]
        if level > top:
            self.entry = node

    def nearest(self, query: np.ndarray, keep: int) -> np.ndarray:
        """Places of about the ``keep`` nodes with the largest inner products."""
        q = np.zeros(self.lifted.shape[1], np.float32)
        q[: len(query)] = query
        found = self._near(q, [self._descend(q, 0)], keep, 0)
        return np.array([p for _, p in found], np.int64)


_INDEX = "dim int, shard long, vectors binary, lifted binary, levels binary, layers array<binary>, entry int, ids binary, owners binary"


def _built(most: int):
    """One row of flat arrays for a shard."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        dim = table.column("dim")[0].as_py()
        rows = np.array(table.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order] + 0.0  # -0.0 equals 0.0
        same, first, owner = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        owner = owner.ravel()
        graph = Graph(same)
        # of equal vectors no more can be among the results than the results there are
        by = np.lexsort((ids, owner))
        place = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
        by = by[place < most]
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "shard": table.column("shard").slice(0, 1),
                "vectors": pa.array([graph.vectors.tobytes()], pa.binary()),
                "lifted": pa.array([graph.lifted.tobytes()], pa.binary()),
                "levels": pa.array([graph.levels.tobytes()], pa.binary()),
                "layers": pa.array([[x.tobytes() for x in graph.layers]], pa.list_(pa.binary())),
                "entry": pa.array([graph.entry], pa.int32()),
                "ids": pa.array([ids[by].astype(np.int64).tobytes()], pa.binary()),
                "owners": pa.array([owner[by].astype(np.int64).tobytes()], pa.binary()),
            }
        )

    return run


def _searched(k: int):
    """The k nearest of one shard for each query of one block."""

    def run(table: pa.Table) -> pa.Table:
        row = {c: table.column(c)[0] for c in table.column_names}
        dim = row["dim"].as_py()
        flat = lambda c, kind: np.frombuffer(row[c].as_py(), kind)
        levels = flat("levels", np.int8)
        n = len(levels)
        layers = [np.frombuffer(x.as_py(), np.int32).reshape(n, -1) for x in row["layers"]]
        vectors = flat("vectors", np.float64).reshape(n, dim)
        graph = Graph.stored(vectors, levels, layers, row["entry"].as_py())
        graph.lifted = flat("lifted", np.float32).reshape(n, dim + 1)
        ids, owners = flat("ids", np.int64), flat("owners", np.int64)
        begins = np.searchsorted(owners, np.arange(n + 1))
        asked = row["queries"].values
        query_ids = asked.field("vec_id").to_numpy()
        queries = np.array(asked.field("v").flatten(), np.float64).reshape(-1, dim)
        out = [], [], []
        for query_id, q in zip(query_ids, queries, strict=True):
            near = graph.nearest(q, max(SEARCH, 4 * k))
            scores = (vectors[near] * q).sum(axis=1)
            sizes = begins[near + 1] - begins[near]
            places = np.repeat(begins[near] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            found, score = ids[places], np.repeat(scores, sizes)
            other = found != query_id
            found, score = found[other], score[other]
            best = np.lexsort((found, -score))[:k]
            for column, values in zip(out, (np.full(len(best), query_id), found[best], score[best]), strict=True):
                column.append(values)
        query_id, vec_id, score = (np.concatenate(c) if c else np.empty(0) for c in out)
        return pa.table(
            {
                "query_id": pa.array(query_id.astype(np.int64)),
                "vec_id": pa.array(vec_id.astype(np.int64)),
                "score": pa.array(score.astype(np.float64)),
            }
        )

    return run


def usable(v: str = "v") -> Column:
    """Whether a vector has only finite components, and one that is not zero."""
    return F.expr(
        f"{v} is not null and size({v}) > 0 and exists({v}, x -> x != 0) "
        f"and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )


def nearest(
    rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest others by inner product.

    ``is_query`` is a condition on ``vec_id``. Scores are exact, on the original
    components in double precision; ties go to the smaller vec_id; which vectors
    are found is up to the graphs (recall is measured in the tests). Null and
    zero vectors, vectors with null or non-finite components and rows without
    id take no part; vectors are compared with those of their length. Of rows
    with one id one counts, the one with the least hash of its vector. A query
    without others has no rows. Other columns are not read.
    """
    ws = Workspace(rows.sparkSession, "hnsw")
    valid = (
        rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & usable())
        .withColumn("h", F.xxhash64("v"))
        .groupBy("vec_id").agg(F.min(F.struct("h", "v"))["v"].alias("v"))
        .withColumn("dim", F.size("v"))
    )
    valid = ws.write(valid, "valid")
    asked = F.coalesce(is_query, F.lit(False))
    sizes = valid.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(asked).alias("asked"))
    sizes = sizes.select(
        "dim",
        F.ceil(F.col("n") / SHARD).alias("shards"),
        F.greatest(F.ceil(F.col("asked") / BLOCK), F.lit(1)).alias("blocks"),
    )
    tasks = min(2 * (sizes.agg(F.sum("shards")).first()[0] or 1), 20_000)
    dealt = valid.join(sizes, "dim").withColumn("at", F.xxhash64(F.lit(7), "vec_id"))
    shards = (
        dealt.select("dim", F.pmod("at", "shards").alias("shard"), "vec_id", "v")
        # shards are small but take long: each gets a task, whatever its bytes
        .repartition(tasks, "dim", "shard")
        .groupBy("dim", "shard")
        .applyInArrow(_built(k + 1), _INDEX)
    )
    index = ws.write(shards, "index")
    queries = (
        dealt.where(asked)
        .groupBy("dim", "shards", F.pmod("at", "blocks").alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    )
    found = (
        index.join(queries.select("dim", "shard", "block", "queries"), ["dim", "shard"])
        .groupBy("dim", "shard", "block")
        .applyInArrow(_searched(k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
