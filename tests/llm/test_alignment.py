import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def shown_bytes():
    """Byte-level characters, from the bytes that print and the rest in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    alphabet = shown_bytes()
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def spell_b(i):
        p = b.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        """(A ids with ends, B ids with ends) of a whole text, or none."""
        if not text:
            return [], []
        whole = (" " + text).encode()
        found = []
        first = a.encode(" " + text, add_special_tokens=False).ids
        spelled = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in first]
        for side in (spelled, [(i, spell_b(i)) for i in b.encode(text)]):
            if b"".join(x for _, x in side) != whole:
                return [], []
            found.append(list(zip([i for i, _ in side], np.cumsum([len(x) for _, x in side]).tolist())))
        return found

    return tokens


def plain(tokens, rows):
    """Whole texts, one token at a time."""
    docs, pairs = [], Counter()
    for doc_id, text in rows:
        first, second = tokens(text)
        ends = sorted({e for _, e in first} & {e for _, e in second})
        groups, at = [], 0
        for e in ends:
            inside = lambda side: ",".join(str(i) for i, x in side if at < x <= e)  # noqa: E731, B023
            groups.append(inside(first) + "|" + inside(second))
            at = e
        last_a, last_b = {e: i for i, e in first}, {e: i for i, e in second}
        links = [(last_a[e], last_b[e]) for e in ends]
        pairs.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        docs.append((doc_id, len(first), len(second), len(groups), links, digest))
    top = {}
    for (_, b), c in pairs.items():
        top[b] = max(top.get(b, 0), c)
    return [
        (i, n_a, n_b, n, len(links), sum(pairs[x] == top[x[1]] for x in links), sum(pairs[x] for x in links), digest)
        for i, n_a, n_b, n, links, digest in docs
    ]


def got(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


ODD = [
    (-1, None), (-2, ""), (-3, " "), (None, "no id here"), (-4, "twice said"), (-4, "twice said"),
    (-5, "a  b   c \n d\te  　f \x85g ᠎ h "), (-6, "<|endoftext|> <s> </s> <0x41> <unk> plain"),
    (-7, "▁ is a space to one of them"), (-8, "中文 字 🙂 Ünï ́ ٣ ² ​﻿ x"), (-9, " leading and trailing "),
    (-10, "x" * 3000 + " " + "ab " * 2000), (-11, "nul \x00 byte"), (-12, "\n"), (-13, "word\n next\n\n  one"),
]


def test_odd_texts(spark, libraries):
    got_rows = got(alignment.align(spark.createDataFrame(ODD, SCHEMA), A, B))
    assert got_rows == sorted(plain(libraries, ODD), key=str)


def test_mixtures(spark, libraries):
    rng = random.Random(5)
    bits = ["the", "a", " ", "  ", "\n", "é", "中", ".", ",", "'s", "\t", "ing", "\x1c", "　", "🙂", "1", "▁", "\r"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(400)]
    assert got(alignment.align(spark.createDataFrame(rows, SCHEMA), A, B)) == sorted(plain(libraries, rows), key=str)


@pytest.mark.parametrize("run, fan", [(alignment.RUN, alignment.FAN), (500, 3), (1, 2)])
def test_documents_whatever_the_runs(spark, libraries, monkeypatch, run, fan):
    monkeypatch.setattr(alignment, "FAN", fan)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(25 if run == 1 else 10**6)
    docs = docs.union(spark.createDataFrame(ODD, SCHEMA)).repartition(5)
    rows = [tuple(r) for r in docs.collect()]
    # workers read the size of a run from the module they import; so it travels as a default here
    monkeypatch.setattr(alignment, "_spilled", small(run))
    clashing = docs.withColumns({c: F.lit("x") for c in ("run", "part", "facts", "n_a", "place")})
    assert got(alignment.align(clashing, A, B)) == sorted(plain(libraries, rows), key=str)


def small(size):
    spilled = alignment._spilled

    def made(models):
        inner = spilled(models)

        def run(batches):
            import tidemark.llm.alignment as here

            before, here.RUN = here.RUN, size
            try:
                yield from inner(batches)
            finally:
                here.RUN = before

        return run

    return made


def test_ties_and_highest_counts():
    keys = np.array([(1 << 32) | 5, (1 << 32) | 9, (2 << 32) | 1, (3 << 32) | 1, (3 << 32) | 2])
    assert alignment._highest(keys, np.array([4, 4, 1, 2, 7])).tolist() == [True, True, True, False, True]


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
