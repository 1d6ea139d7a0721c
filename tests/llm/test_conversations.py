import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as cv

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(c, t, role, text)] * (2 if fate == 3 else 1)
    return out


def plain(rows):
    """Uniform-cost search over whole paths: no bound, no table of failures, no stretches."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        faults.append(
            "blank" if not solid else "duplicate" if (role, text) in seen
            else "truncated" if solid[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        for x in "ua":
            if x in NEXT[last]:
                heapq.heappush(queue, (cost + 2, audit + "I", i, x, (*lines, FULL[x] + ":")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, last, lines))
            if faults[i] not in ("blank", "duplicate"):
                cost += faults[i] == "truncated"
                if role and role[0] in NEXT[last]:
                    heapq.heappush(queue, (cost, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                for x in "ua":
                    if x in NEXT[last] and role[:1] != x:
                        line = f"{FULL[x]}:{text}"
                        heapq.heappush(queue, (cost + 2, audit + "R", i + 1, x, (*lines, line)))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def want(rows, ids):
    return {c: plain([r for r in rows if r[0] == c]) for c in ids}


def got(df):
    found = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert len(found) == df.count()
    return found


def made(seed, n, longest):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why", "Why? ", " ", "", "a.b", "Fine.\n", "ok\t"]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "", None, "usher"]
    for c in range(n):
        for t in range(rng.randrange(longest)):
            turn = None if rng.random() < 0.05 else t + rng.randrange(3)
            if rng.random() < 0.7:
                rows.append((c, turn, ["user", "assistant"][t % 2], f"{rng.random()}."))
            else:
                rows.append((c, turn, rng.choice(roles), rng.choice([*texts, None])))
    return rows


def test_random_conversations(spark):
    rows = made(1, 150, 12)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(cv.repair(df, spark.range(150).toDF("conv_id"))) == want(clean, range(150))


@pytest.mark.parametrize("stretch", [1, 2, 5])
def test_stretches_change_nothing(monkeypatch, stretch):
    monkeypatch.setattr(cv, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(400):
        symbols = ["".join((rng.choice("suax "), rng.choice("bdtkkkk"))) for _ in range(rng.randrange(1, 14))]
        chain = cv._Chain()
        for s in symbols:
            chain.add(s)
        assert chain.end() == cv.search(tuple(symbols))


def test_damage_and_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(*SCHEMA.split()[::2]).collect()]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, cv.damage(df).collect())) == sorted(damaged(rows))
    ids = {r[0] for r in rows}
    assert got(cv.repair(cv.damage(df), df)) == want(damaged(rows), ids)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "x."), (7, None, "user", "a"), (7, None, "user", "a"),
        (8, 1, "assistant", "word " * 200_000 + "."), (8, 1, "assistant", None), (9, 5, None, ""), (10, 2, "", "a."),
    ]
    ids = {None, 7, 8, 9, 10}
    # a table may hold any column; these are named like results and steps
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit(5) for c in ("fault", "part", "facts", "kept", "cost", "_fate", "_copy")}
    )
    assert got(cv.repair(cv.damage(df), df)) == want(damaged(rows), ids)


def test_conversation_that_loses_all_rows(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(c, 0, "user", "Hi.")], SCHEMA)
    assert got(cv.repair(cv.damage(df), df)) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_a_long_conversation_takes_stretches(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(3000)]
    out = got(cv.repair(cv.damage(spark.createDataFrame(rows, SCHEMA)), spark.range(1, 2).toDF("conv_id")))
    assert out == want(damaged(rows), [1])


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cv.repair(cv.damage(df), df).count() == 0
