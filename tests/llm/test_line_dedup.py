import random

import numpy as np
import pyarrow as pa

from llm import brute
from tidemark.llm import line_dedup as ld

SF = "/root/testdata/sf0.001"


def chars(line):
    s = line.decode()
    return frozenset(s[i : i + 8] for i in range(len(s) - 7)) or frozenset([("whole", s)])


def plain(rows):
    """(doc_id, line_no) -> (group size, first place) of rows with distinct ids and no nulls among them."""
    places, forest = {}, brute.Forest()
    for i, t in rows:
        for n, line in brute.lines_of(t):
            places.setdefault(line, []).append((i, n))
    sets = {line: chars(line) for line in places}
    by = {}
    for line, s in sets.items():
        forest.find(line)
        for x in s:
            by.setdefault(x, []).append(line)
    for line, s in sets.items():
        counts = {}
        for x in s:
            for other in by[x]:
                if other < line:
                    counts[other] = counts.get(other, 0) + 1
        for other, c in counts.items():
            if 100 * c >= 80 * (len(s) + len(sets[other]) - c):
                forest.join(line, other)
    groups = {}
    for line, ps in places.items():
        groups.setdefault(forest.find(line), []).extend(ps)
    return {p: (len(ps), min(ps)) for ps in groups.values() for p in ps}


def judged(rows):
    return {(r.doc_id, r.line_no): (r.group_size, (r.keep_doc_id, r.keep_line_no)) for r in rows}


def test_shingles_and_bands():
    lines = [b"abcdefgh", b"abc", "ñandú 漢字 word".encode(), b"xabcdefgh", b"abcdefghabcdefgh"]
    sets = ld.char_sets(pa.array([x.decode() for x in lines]))
    assert [len(s) for s in sets] == [len(chars(x)) for x in lines]
    assert set(sets[0]) < set(sets[3]) and set(sets[0]) < set(sets[4])
    alone = [ld.bands(*ld.char_shingles([x]))[0] for x in lines]
    assert (np.stack(alone) == ld.bands(*ld.char_shingles(lines))).all()


def test_recall_of_bands():
    rng = random.Random(1)
    missed = 0
    for _ in range(400):
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(120))
        at = rng.randrange(20, 100)
        b = a[:at] + "#" + a[at + 1 :]  # similarity about 0.87
        x, y = ld.bands(*ld.char_shingles([a.encode(), b.encode()]))
        missed += not (x == y).any()
    assert missed == 0


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = ld.repeated_lines(docs).collect()
    want = plain(rows)
    assert judged(got) == want and len(got) == len(want)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.keep_doc_id, r.keep_line_no)) for r in got)


def test_large_loose_group(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(150))
    rows = []
    for i in range(120):
        s = list(base)
        for _ in range(rng.randrange(4)):
            s[rng.randrange(150)] = rng.choice("#+*")
        rows.append((i, f"own line {rng.random()} of {i}\n{''.join(s)}\n  \n{'Thanks!' if i % 2 else 'thanks! '}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert judged(ld.repeated_lines(docs).collect()) == plain(rows)


def test_odd_rows_and_texts_without_repeats(spark):
    docs = spark.createDataFrame(
        [
            (1, "Alpha line\n\nbeta line\r\nalpha LINE ", 1), (2, None, 1), (3, "", 1), (4, " \n\t", 1),
            (5, "beta line\ngamma", 1), (5, "beta line\ngamma", 1), (None, "gamma\ndelta", 1),
        ],
        "doc_id long, text string, node int",
    )
    lines = ld.repeated_lines(docs)
    got = sorted(str((r.doc_id, r.line_no, r.group_size, r.keep_doc_id, r.keep_line_no, r.kept)) for r in lines.collect())
    assert got == sorted([
        "(1, 0, 2, 1, 0, True)", "(1, 3, 2, 1, 0, False)", "(1, 2, 3, 1, 2, True)",
        "(5, 0, 3, 1, 2, False)", "(5, 0, 3, 1, 2, False)", "(5, 1, 3, 5, 1, True)", "(5, 1, 3, 5, 1, True)",
        "(None, 0, 3, 5, 1, False)", "(None, 1, 1, None, 1, True)",
    ])
    left = ld.without_repeated_lines(docs, lines)
    assert left.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(
        str(x) for x in [
            (1, "Alpha line\n\nbeta line\r"), (2, None), (3, ""), (4, " \n\t"), (5, "gamma"), (5, "gamma"), (None, "delta"),
        ]
    )


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ld.repeated_lines(docs).count() == 0
