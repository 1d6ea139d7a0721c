import random

import numpy as np
import pyarrow as pa
import pytest

from llm import brute
from tidemark.llm import near_dedup as nd
from tidemark.llm import textkit
from tidemark.llm.components import components
from tidemark.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"


def judged(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in nd.near_duplicates(docs, **kw).collect()}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return " ".join(words)


def test_word_hashes_follow_words_not_places():
    rows = ["Ab c  ab", None, "", "\t c\x0bAB\n", "é\x85é c", "ab", "c"]
    data, offsets = textkit.flat(pa.array(rows))
    hashes, first = textkit.word_hashes(data, offsets)
    assert np.diff(first).tolist() == [3, 0, 0, 2, 2, 1, 1]
    ab, c = hashes[0], hashes[1]
    assert hashes[2] == ab and hashes[3] == c and hashes[4] == ab
    assert hashes[6] == c and hashes[7] == ab and hashes[8] == c


def test_pieces_change_nothing(monkeypatch):
    rng = random.Random(3)
    rows = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(400))) for _ in range(50)]
    rows.append("z" * 9000)
    data, offsets = textkit.flat(pa.array(rows))
    whole = textkit.word_hashes(data, offsets)
    monkeypatch.setattr(textkit, "PIECE", 64)
    pieces = textkit.word_hashes(data, offsets)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


@pytest.mark.parametrize("k", [1, 2, 5])
def test_sets_have_the_size_of_plain_sets(k):
    rng = random.Random(5)
    rows = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 30, 1)]
    sets = textkit.shingle_sets(pa.array(rows), k)
    assert [len(s) for s in sets] == [len(brute.shingle_set(t, k)) for t in rows]


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    pool = textkit.mix(rng.integers(0, 2**63, 3000).astype(np.uint64))
    found = []
    for _ in range(40):
        order = rng.permutation(pool)
        a, b = np.sort(order[:900]), np.sort(order[100:1000])  # similarity 0.8
        x, y = nd.registers(a).astype(int), nd.registers(b).astype(int)
        est, behind = nd.joint_estimate(
            np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([900]), np.array([900]), 0.8
        )
        assert behind[0] < nd.DOUBT
        found.append(est[0])
    assert abs(np.mean(found) - 0.8) < 0.02


def test_registers_of_a_union_are_maxima():
    rng = np.random.default_rng(4)
    a, b = (textkit.mix(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(2))
    union = nd.registers(np.union1d(a, b))
    assert (union == np.maximum(nd.registers(a), nd.registers(b))).all()


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force_on_documents(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute.near_components(rows, k, 80)
    got = nd.near_duplicates(docs, shingle_words=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_loose_group_and_chains(spark):
    """Copies of one text, each edited, of which many pairs lie just below the threshold."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, edited(base, rng.randrange(9), rng)) for i in range(150)]
    chain = list(base)
    for i in range(150, 190):  # each close to the one before, the ends far apart
        chain[(i - 150) * 3 : (i - 150) * 3 + 3] = [f"c{i}a", f"c{i}b", f"c{i}c"]
        rows.append((i, " ".join(chain)))
    rows += [(1000 + i, " ".join(f"u{i}-{j}" for j in range(50))) for i in range(30)]
    want = brute.near_components(rows, 2, 80)
    got = judged(spark, rows, shingle_words=2)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_empty_null_short_and_repeated(spark):
    docs = spark.createDataFrame(
        [
            (5, None, 1), (6, "", 1), (7, " \n\t", 1), (8, "One", 2), (9, "one ", 2), (10, "one one", 2),
            (11, "a b c", 3), (11, "a b c", 3), (None, "A b  c", 3), (None, "solo words here", 4), (12, "two", 5),
        ],
        "doc_id long, text string, registers int",
    )
    got = sorted(
        (tuple(r)[:4] for r in nd.near_duplicates(docs, shingle_words=2).collect()),
        key=lambda r: (r[0] is None, r[0] or 0, r[2] is None),
    )
    assert got == [
        (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False),
        (10, 1, 10, True), (11, 2, 11, True), (11, 2, 11, True), (12, 1, 12, True),
        (None, 2, 11, False), (None, 2, None, True),
    ]


def test_one_of_several_texts_with_one_id_or_none_is_kept(spark):
    rows = [(None, "a b c"), (None, "A b c"), (7, "d e f"), (7, "D e f"), (7, "d  e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(docs, shingle_words=2).collect()
    assert sorted(str(r.doc_id) for r in got if r.kept) == ["7", "None"]


def test_no_rows(spark):
    assert judged(spark, []) == {}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 230)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)]
    forest = brute.Forest()
    for a, b in links:
        if a != b:
            forest.join(a, b)
    df = spark.createDataFrame([(b, a) for a, b in links], "u long, v long")
    got = {r.node: r.root for r in components(df, Workspace(spark, "t")).collect()}
    assert got == {x: forest.find(x) for a, b in links if a != b for x in (a, b)}
