import hashlib
import random

from llm import brute
from tidemark.llm.exact_dedup import copies, exact_duplicates


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(brute.lower(t), []).append(i)
    return {
        (i, max(groups[brute.lower(t)]), len(groups[brute.lower(t)]), i == max(groups[brute.lower(t)]), hashlib.sha256(brute.lower(t).encode()).hexdigest())
        for i, t in rows
    }


def test_equals_brute_force(spark):
    rng = random.Random(1)
    bits = ["A", "a", "É", "é", " ", "ß", "x" * 70, "y"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(4)))) for i in range(500)]
    rows += [(500, None), (501, None)]
    rows += [(600 + i, "p" * 64 + str(i % 7)) for i in range(30)]  # alike up to the prefix
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_duplicates(docs).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == plain(rows)


def test_only_repeated_texts_reach_the_last_step(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "AB"), (3, "ac"), (4, "abc")], "doc_id long, text string")
    assert [(r.keep_id, r.group_size) for r in copies(docs).collect()] == [(2, 2)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "a", 1), (None, "a", 1), (5, "b", 1), (None, "b", 1), (7, "c", 1), (7, "c", 1), (8, "", 1), (9, None, 1)],
        "doc_id long, text string, size int",
    )
    rows = exact_duplicates(docs).collect()
    got = sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in rows)
    assert got == [
        "(5, 5, 2, True)", "(7, 7, 2, True)", "(7, 7, 2, True)", "(8, 9, 2, False)", "(9, 9, 2, True)",
        "(None, 5, 2, False)", "(None, None, 2, True)", "(None, None, 2, True)",
    ]


def test_no_rows(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
