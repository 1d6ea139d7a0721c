import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
BITS = (
    "a b the ing é ß 1 23 ' s 're 'll ! *** 中 文 🙂 \x85 \x1c <|endoftext|> <| |> endof "
    "Ünï ́ ٣ ² ª ​ ﻿ _ ½ 　"
).split(" ") + [" ", "  ", "\n", "\t", " \n", "x" * 30]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture
def coder():
    with open(PATH) as f:
        return bpe.Codec(f.read())


def halves(text, depth):
    n = 2**depth
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_mixtures_in_one_go_and_by_halves(library, coder):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 100)))
        want = ids(library, text)
        assert coder.encode(text).tolist() == want
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)
        try:
            parts = [coder.leaf(t) for t in halves(text, rng.randrange(1, 5))]
        except bpe._Disagreed:
            continue
        assert coder.tree(parts).tolist() == want


def test_unsplit_runs(library, coder, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 16)
    rng = random.Random(2)
    for _ in range(800):
        letters = rng.choice(["ab", "abcdefghij", "aé中ß", "01", "*!.", "Thein", " \n"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 400)))
        if rng.random() < 0.3:
            text += " " + "".join(rng.choice(letters) for _ in range(300)) + "\n  "
        coder.known.clear()
        coder.spaced.clear()
        want = ids(library, text)
        assert coder.encode(text).tolist() == want
        assert coder.tree([coder.leaf(t) for t in halves(text, rng.randrange(1, 5))]).tolist() == want


def test_long_unsplit_text(library, coder):
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(20_000))
    assert coder.encode(text).tolist() == ids(library, text)


def test_a_small_memory_changes_nothing(library, coder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    text = "one two three four five six two one seven one two"
    assert coder.encode(text).tolist() == ids(library, text)


@pytest.mark.parametrize("leaf", [64, bpe.LEAF])
def test_documents_round_trip(spark, library, leaf):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(
        [
            (-1, None), (-2, ""), (-3, " "), (None, "no id"), (-4, "twice"), (-4, "twice"),
            (-5, "²½ mixed \x85 classes " * 20), (-6, "x" * 300 + "<|endoftext|>" * 30 + "\n   " * 50),
        ],
        "doc_id long, text string",
    )
    docs = docs.union(odd).withColumn("ids", docs.doc_id * 0)
    got = bpe.decode(bpe.encode(docs, PATH, leaf_chars=leaf), PATH).collect()
    want = sorted((str(r.doc_id), r.text or "", ids(library, r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), r.text, r.ids) for r in got) == want


def test_digests(spark, library):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH)).collect()}
    want = ids(library, "Hello world")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(rows[1]) == (1, len(want), sha(",".join(map(str, want))), sha("Hello world"))
    assert tuple(rows[2]) == (2, 0, sha(""), sha(""))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH)).count() == 0
