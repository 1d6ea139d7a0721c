import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share out, cut at the cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / rest for s in names}
        above = {s for s in names if target[s] > cap * sizes[s] + 1e-9} - full
        if not above:
            return target
        full |= above


def words(n):
    return " ".join(["w"] * n)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        source = rng.choice(["a", "a", "a", "a", "b", "B", "é", "😀", "�", None, "tiny"])
        if source == "tiny" and rng.random() < 0.9:
            source = "a"
        rows.append((i, words(int(rng.paretovariate(1.2) * 20) % 3000), source))
    return rows


def test_targets_and_words_taken(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes, taken = {}, {}
    for i, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = plain_targets(sizes)
    shortest = {}
    for r in got:
        assert r.mix_size == len(rows[r.doc_id][1].split())
        assert r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(want[r.source], rel=1e-9)
        assert r.mix_taken == r.mix_size * r.mix_copies and 0 <= r.mix_copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
    assert len(got) == len(rows) and len({r.doc_id for r in got}) == len(rows)
    for s, t in taken.items():
        assert t == pytest.approx(want[s], rel=0.01), s
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rates_are_tilted(spark):
    """Of a source cut to a third, long texts go first; log-rates are linear in size."""
    rows = [(i, words(10 + i % 50), "a") for i in range(5000)]
    rows += [(5000 + i, words(30), "b") for i in range(3000)]
    rows += [(8000 + i, words(30), "c") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 1, 1)).where("source = 'a'")
    rate = {r.mix_size: r.r for r in got.groupBy("mix_size").agg(F.avg("mix_copies").alias("r")).collect()}
    assert rate[10] > rate[30] > rate[59]
    assert rate[20] / rate[10] == pytest.approx(rate[50] / rate[40], abs=0.1)


def test_a_cell_is_dealt_the_same_in_chunks(spark, rows, monkeypatch):
    same = [(i, words(5), "a") for i in range(900)] + [(1000 + i, words(5), "b") for i in range(300)]
    docs = spark.createDataFrame(same, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "CHUNK", 50)
    got = mixing.mix(docs).collect()
    want = plain_targets({"a": 4500, "b": 1500})
    for s in "ab":
        assert sum(r.mix_taken for r in got if r.source == s) == pytest.approx(want[s], abs=5)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "a", 1), (2, "", "a", 1), (None, "x y", None, 1), (None, "x y", None, 1), (3, "z", "b", 2), (3, "z", "b", 2)],
        "doc_id long, text string, source string, size int",
    )
    got = mixing.mix(docs, columns=["doc_id", "source", "size"]).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.mix_size) for r in got} == {(1, 0), (2, 0), (None, 2), (3, 1)}
    assert all(r.mix_copies <= 3 and r.mix_target <= 3 * r.mix_source_size for r in got)
    assert {r.size for r in got} == {1, 2}


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r.mix_taken, r.mix_target) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]


def test_documents(spark):
    """Fifty documents a source suffice to meet the targets within half a percent."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = mixing.mix(docs).groupBy("source").agg(F.sum("mix_taken").alias("t"), F.first("mix_target").alias("g"))
    got = sums.collect()
    assert got and all(r.t == pytest.approx(r.g, rel=0.005) for r in got)
