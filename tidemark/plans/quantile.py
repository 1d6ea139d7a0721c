"""Gradient boosting for the pinball loss, its histograms as DataFrame aggregates.

Features are cut into bins at their quantiles, once. A round fits a tree of
DEPTH levels to each quantile level: the gradient of the pinball loss of a row is
q where the row lies above its prediction and q - 1 elsewhere. Sums of gradients
by (quantile, node, feature, bin) are one aggregate for all quantiles, nodes and
features of a tree level; running sums over its bins give the gain of every
split, and one row a node, the best, comes to the driver. A leaf moves by the
quantile of its residuals. So what is shuffled and held depends on bins, nodes
and features, not on rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scalar import sort4
from tidemark.plans.features import assert_no_banned
from tidemark.session import written

LEVELS = {n: float(q) for n, q in C.QUANTILE_LEVELS.items()}
ROUNDS, DEPTH, BINS, MIN_LEAF, RATE = 60, 3, 32, 40, 0.2
ACCURACY = 10_000  # of the sketches that cut bins and move leaves
STORED = 4  # rounds between two writings of the predictions


@dataclass
class QuantileModel:
    """Bin edges, a start and trees for each quantile level; all bounded by its settings.

    A tree is a list of nodes in breadth-first order: [feature, bin] sends rows
    of a larger bin right; None ends there. ``leaves`` has the move of each
    node of the level below, by number.
    """

    features: list[str]
    edges: list[list[float]]
    levels: dict[str, float]
    start: list[float]
    trees: list[list[dict]] = field(default_factory=list)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the quantiles as columns, put in order so that they never cross."""
        shared = rows.sparkSession.sparkContext.broadcast(self)
        names = list(self.levels)
        outside = [c for c in rows.columns if c not in names]
        frame = rows.select(
            *outside, F.array(*[F.col(f).cast("double") for f in self.features]).alias("__x")
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                found = model.values(batch.column(len(outside)))
                columns = [batch.column(i) for i in range(len(outside))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *[pa.array(v) for v in found]], names=[*outside, *names]
                )

        kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in outside]
        out = frame.mapInArrow(run, ", ".join([*kinds, *[f"`{n}` double" for n in names]]))
        if names != list(LEVELS):
            return out
        ordered = out.withColumn("__q", sort4(*[F.col(n) for n in names]))
        return ordered.select(*outside, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])

    def values(self, vectors: pa.ListArray) -> list[np.ndarray]:
        """The quantiles of feature vectors, missing values in the lowest bin."""
        k = len(self.features)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
        bins = np.zeros(flat.shape, np.int64)
        for i, edges in enumerate(self.edges):
            bins[:, i] = np.where(np.isnan(flat[:, i]), 0, 1 + np.searchsorted(edges, flat[:, i], side="left"))
        out = []
        for level, start in enumerate(self.start):
            value = np.full(len(flat), start)
            for round_ in self.trees:
                tree = round_[level]
                node = np.zeros(len(flat), np.int64)
                for number, split in enumerate(tree["splits"]):
                    if split is not None:
                        here = node == number
                        node[here] = 2 * number + 1 + (bins[here, split[0]] > split[1])
                value += np.array([tree["leaves"].get(str(i), 0.0) for i in range(2 ** (DEPTH + 1))])[node]
            out.append(value)
        return out


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """The inner quantiles of each feature, without repeats: ``bins`` - 1 numbers at most."""
    marks = [i / bins for i in range(1, bins)]
    found = rows.agg(
        *[F.percentile_approx(F.col(f).cast("double"), marks, ACCURACY).alias(f"e{i}") for i, f in enumerate(features)]
    ).first()
    return [sorted(set(found[f"e{i}"] or [])) for i in range(len(features))]


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """0 for a missing value, else one more than the edges below the value."""
    below = [F.when(value > F.lit(e), 1).otherwise(0) for e in edges]
    total = below[0] if below else F.lit(0)
    for b in below[1:]:
        total = total + b
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(total + 1).cast("int")


def gradient_histogram(rows: DataFrame, levels: dict[str, float] = LEVELS) -> DataFrame:
    """(level, node, feature, bin, n, gradient) of rows (y, preds, nodes, bins).

    ``preds`` and ``nodes`` are arrays with an entry for each quantile level, and
    ``bins`` with one for each feature. A null node is out of the tree. Partial
    sums precede the shuffle, so a bin with a third of all rows is a row a task.
    """
    shares = F.array(*[F.lit(q) for q in levels.values()])
    each = rows.select("y", "preds", "nodes", "bins", F.posexplode(shares).alias("level", "q"))
    each = each.select(
        "level",
        F.element_at("nodes", F.col("level") + 1).alias("node"),
        (F.col("q") - (F.col("y") <= F.element_at("preds", F.col("level") + 1)).cast("int")).alias("g"),
        F.posexplode("bins").alias("feature", "bin"),
    )
    return (
        each.where("node is not null")
        .groupBy("level", "node", "feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("gradient"))
    )


def best_splits(histogram: DataFrame, min_leaf: int = MIN_LEAF) -> DataFrame:
    """(level, node, feature, bin, gain): the split of each node that gains most, if any gains.

    Rows of bins up to ``bin`` go left. The gain is the growth of the sum of
    G^2 / n; ties go to the first feature and bin. A histogram is bounded, so
    are its windows.
    """
    up = Window.partitionBy("level", "node", "feature").orderBy("bin")
    whole = Window.partitionBy("level", "node", "feature")
    cut = histogram.select(
        "level", "node", "feature", "bin",
        F.sum("n").over(up).alias("nl"), F.sum("gradient").over(up).alias("gl"),
        F.sum("n").over(whole).alias("nt"), F.sum("gradient").over(whole).alias("gt"),
    )
    square = lambda g, n: F.col(g) * F.col(g) / F.col(n)
    cut = cut.withColumns({"nr": F.col("nt") - F.col("nl"), "gr": F.col("gt") - F.col("gl")})
    cut = cut.where((F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf))
    cut = cut.withColumn("gain", F.round(square("gl", "nl") + square("gr", "nr") - square("gt", "nt"), 6))
    best = F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "bin")).alias("b")
    return (
        cut.where("gain > 0").groupBy("level", "node").agg(best)
        .select("level", "node", "b.feature", "b.bin", (-F.col("b.loss")).alias("gain"))
    )


def _node_after(node: Column, splits: list) -> Column:
    """The node below, for rows whose node is split."""
    out = node
    for number, split in enumerate(splits):
        if split is not None:
            right = (F.element_at("bins", split[0] + 1) > split[1]).cast("int")
            out = F.when(node == number, 2 * number + 1 + right).otherwise(out)
    return out


def fit_quantiles(
    train: DataFrame,
    features: Sequence[str],
    levels: dict[str, float] = LEVELS,
    rounds: int = ROUNDS,
    bins: int = BINS,
    min_leaf: int = MIN_LEAF,
    rate: float = RATE,
) -> QuantileModel:
    """a model of every quantile level of ``y``; banned columns are refused.

    Rows without ``y`` teach nothing; without rows the model has no trees and
    predicts zeros. Predictions stand beside the rows and are written every
    STORED rounds, so neither plans nor lineage grow with the rounds.
    """
    features = list(features)
    assert_no_banned(train.select(*features))
    train = train.where(F.col("y").isNotNull())
    edges = bin_edges(train, features, bins)
    starts = train.agg(F.percentile_approx(F.col("y").cast("double"), list(levels.values()), ACCURACY)).first()[0]
    model = QuantileModel(features, edges, dict(levels), list(starts or [0.0] * len(levels)))
    if starts is None:
        return model
    columns = [bin_of(F.col(f).cast("double"), e) for f, e in zip(features, edges, strict=True)]
    state = written(
        train.select(
            F.col("y").cast("double").alias("y"), F.array(*columns).alias("bins"),
            F.array(*[F.lit(float(s)) for s in model.start]).alias("preds"),
        ),
        "binned",
    )
    for number in range(1, rounds + 1):
        trees, nodes = [{"splits": [], "leaves": {}} for _ in levels], F.array(*[F.lit(0)] * len(levels))
        rows = state.withColumn("nodes", nodes)
        for depth in range(DEPTH):
            found = {
                (r["level"], r["node"]): [r["feature"], r["bin"]]
                for r in best_splits(gradient_histogram(rows, levels), min_leaf).collect()  # a row a node
            }
            at = range(2**depth - 1, 2 ** (depth + 1) - 1)
            for level, tree in enumerate(trees):
                tree["splits"] += [found.get((level, i)) for i in at]
            if not found:
                break
            below = [_node_after(F.col("nodes")[i], t["splits"]) for i, t in enumerate(trees)]
            # rows whose node was not split stay in it; its number is not asked for again
            rows = rows.withColumn("nodes", F.array(*below))
        shares = list(levels.values())
        residual = F.posexplode(F.arrays_zip("nodes", "preds")).alias("level", "z")
        leaves = rows.select("y", residual).groupBy("level", F.col("z.nodes").alias("node")).agg(
            F.percentile_approx(F.col("y") - F.col("z.preds"), shares, ACCURACY).alias("moves")
        )
        for r in leaves.collect():  # a row a leaf
            trees[r["level"]]["leaves"][str(r["node"])] = rate * r["moves"][r["level"]]
        model.trees.append(trees)
        state = rows.select("y", "bins", _moved(trees).alias("preds"))
        if number % STORED == 0 and number < rounds:
            state = written(state, "boosted")
    return model


def _moved(trees: list[dict]) -> Column:
    """The predictions after a round."""
    out = []
    for level, tree in enumerate(trees):
        move = F.lit(0.0)
        for node, value in tree["leaves"].items():
            move = F.when(F.col("nodes")[level] == int(node), F.lit(value)).otherwise(move)
        out.append(F.col("preds")[level] + move)
    return F.array(*out)


def save_quantiles(spark: SparkSession, path: str, model: QuantileModel) -> None:
    """The model as one JSON document."""
    text = json.dumps(asdict(model), sort_keys=True)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(path)


def load_quantiles(spark: SparkSession, path: str) -> QuantileModel:
    return QuantileModel(**json.loads(spark.read.text(path, wholetext=True).first()["value"]))
