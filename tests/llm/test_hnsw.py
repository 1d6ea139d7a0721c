import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hnsw

SF = "/root/testdata/sf0.01"


def plain(rows, k, every=20):
    """The k nearest of each query, by looking at all."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float64)
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        scores = (vectors * vectors[at]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if j != at][:k]
        out[int(ids[at])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def searched(spark, rows, k=20, **kw):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    found = hnsw.nearest(df, F.col("vec_id") % 20 == 0, k, **kw).orderBy("query_id", "rank").collect()
    out = {}
    for r in found:
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("shard", [100, 8192])
def test_recall_and_scores_on_the_table(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "BLOCK", 7)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = plain(rows, 20), searched(spark, rows)
    assert got.keys() == want.keys() and recall(got, want) > 0.97
    vectors = dict(rows)
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        for i, s in found:
            assert i != q and s == pytest.approx(np.dot(vectors[i], vectors[q]), abs=1e-6)


def test_recall_of_clusters_and_unequal_lengths():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 3000)] + 0.2 * rng.normal(size=(3000, 24))) * rng.uniform(0.2, 3, (3000, 1))
    graph = hnsw.Graph(x)
    hits = []
    for q in range(0, 3000, 50):
        want = set(np.argsort(-(x @ x[q]))[:20].tolist())
        got = graph.nearest(x[q], hnsw.SEARCH)
        got = got[np.argsort(-(x[got] @ x[q]))][:20]
        hits.append(len(want & set(got.tolist())) / 20)
    assert np.mean(hits) > 0.9
    assert graph.layers[0].shape == (3000, 2 * hnsw.LINKS) and graph.layers[0].dtype == np.int32


def test_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    hot = np.round(rng.normal(size=8), 2)
    rows = [(i, hot if i % 3 == 0 else np.round(rng.normal(size=8), 2)) for i in range(600)]
    got, want = searched(spark, rows), plain([(i, np.float32(v)) for i, v in rows], 20)
    for q in want:
        if q % 3 == 0:  # the nearest are copies, the smallest ids first
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert recall(got, want) > 0.97


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [
            (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1),
            (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (7, [], 1), (20, [1.0, 2.0, 3.0], 1), (40, [2.0, 0.0], 1),
        ],
        "vec_id long, embedding array<float>, shard int",
    )
    got = hnsw.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 40, 2.0), (0, 2, 1, 0.5), (40, 1, 0, 2.0), (40, 2, 1, 1.0)]
    assert hnsw.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
