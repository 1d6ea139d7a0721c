"""Boosting for the pinball loss: its histogram and splits, and what it gains over residual bands."""

import random

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from tidemark.plans import quantile as Q
from tidemark.plans import train as TR
from tidemark.session import scratch_dir


def uneven(spark, n=6000, seed=1):
    """A spread that grows tenfold with one feature, which bands per horizon group cannot follow."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        x, z = rng.random(), rng.choice([0.0, 1.0, None])
        spread = 1 + 9 * (x > 0.6)
        y = 20 * x + (5 if z == 1.0 else 0) + rng.gauss(0, spread)
        rows.append(("s", at(i), at(i + 1), 1 + i % 8, x, z, y))
    return spark.createDataFrame(
        rows, "series_key string, origin_utc timestamp, target_utc timestamp, horizon_periods int, "
        "x double, z double, y double")


def plain_pinball(y, p, q):
    return float(np.mean(np.maximum(q * (y - p), (q - 1) * (y - p))))


def test_bins_count_edges_below_and_miss_to_zero(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (1.0,), (1.5,), (9.0,)], "v double")
    got = [r[0] for r in df.select(Q.bin_of(F.col("v"), [0.5, 1.0, 2.0])).collect()]
    assert got == [0, 0, 1, 2, 3, 4]
    assert [r[0] for r in df.select(Q.bin_of(F.col("v"), [])).collect()] == [0, 0, 1, 1, 1, 1]


def test_histogram_and_best_split_against_plain_loops(spark):
    rng = random.Random(2)
    rows = [
        (rng.gauss(0, 1), [rng.gauss(0, 1) for _ in range(2)], [rng.choice([1, 2]), rng.choice([0, None])],
         [rng.randrange(4), rng.randrange(3)])
        for _ in range(500)
    ]
    df = spark.createDataFrame(rows, "y double, preds array<double>, nodes array<int>, bins array<int>")
    levels = {"a": 0.1, "b": 0.5}
    want = {}
    for y, preds, nodes, bins in rows:
        for level, q in enumerate(levels.values()):
            if nodes[level] is None:
                continue
            for f, b in enumerate(bins):
                key = (level, nodes[level], f, b)
                n, g = want.get(key, (0, 0.0))
                want[key] = (n + 1, g + (q if y > preds[level] else q - 1))
    got = Q.gradient_histogram(df, levels)
    assert {tuple(r)[:4]: (r.n, pytest.approx(r.gradient)) for r in got.collect()} == want
    best = {}
    for level, node in {k[:2] for k in want}:
        for f in (0, 1):
            cells = sorted((b, *v) for (l, m, g, b), v in want.items() if (l, m, g) == (level, node, f))
            n_all, g_all = sum(c[1] for c in cells), sum(c[2] for c in cells)
            n = g = 0
            for b, dn, dg in cells[:-1]:
                n, g = n + dn, g + dg
                gain = round(g * g / n + (g_all - g) ** 2 / (n_all - n) - g_all**2 / n_all, 9)
                if n >= 20 and n_all - n >= 20 and gain > 0:
                    best.setdefault((level, node), []).append((-gain, f, b))
    found = {(r.level, r.node): (r.feature, r.bin) for r in Q.best_splits(got, 20).collect()}
    assert found == {k: min(v)[1:] for k, v in best.items()}


def test_it_beats_residual_bands_on_rows_it_never_saw(spark):
    data, held = uneven(spark), uneven(spark, 3000, 7)
    model = Q.fit_quantiles(data, ["x", "z"], rounds=12, rate=0.4)
    mine = model.predict(held)
    rows = np.array([[r.y, r.q025, r.q10, r.q90, r.q975] for r in mine.collect()])
    assert (np.diff(rows[:, 1:], axis=1) >= 0).all()
    banded = TR.train(data, ["x", "z"], max_iter=8, max_depth=3, min_leaf=40, learning_rate=0.3).forecast(held)
    other = np.array([[r.y, r.q025, r.q10, r.q90, r.q975] for r in banded.collect()])
    for i, q in enumerate(Q.LEVELS.values(), 1):
        assert plain_pinball(rows[:, 0], rows[:, i], q) < plain_pinball(other[:, 0], other[:, i], q)
    inside = lambda r: ((r[:, 0] >= r[:, 2]) & (r[:, 0] <= r[:, 3])).mean()
    assert 0.75 < inside(rows) < 0.85
    # the driver's trees and the rows' columns say the same
    path = scratch_dir(spark, "quantiles")
    Q.save_quantiles(spark, path, model)
    again = Q.load_quantiles(spark, path).predict(held)
    assert sorted(map(str, again.collect())) == sorted(map(str, mine.collect()))


def test_nothing_to_learn_and_banned_features(spark):
    none = uneven(spark, 50).limit(0)
    model = Q.fit_quantiles(none, ["x", "z"], rounds=2)
    assert [model.trees, model.start] == [[], [0.0] * 4]
    assert model.predict(uneven(spark, 5)).agg(F.sum("q10")).first()[0] == 0
    with pytest.raises(Exception, match="banned"):
        Q.fit_quantiles(uneven(spark, 50).withColumn("actual", F.lit(1.0)), ["x", "actual"])
