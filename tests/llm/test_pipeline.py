import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from llm import brute
from tidemark.llm import language

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "bpe"]


def test_every_stage_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.collect()

    first = cp.identify_language(spark, docs, SF)
    assert first.columns == COLUMNS
    rejected = language.classify(docs, language.learn(docs)).where("rejected").count()
    kept = first.collect()
    assert len(kept) == len(given) - rejected and set(kept) <= set(given)

    second = cp.drop_copies(spark, first, SF)
    assert second.columns == COLUMNS
    last = {}
    for r in kept:
        last[brute.lower(r.text)] = max(last.get(brute.lower(r.text), -1), r.doc_id)
    rows = second.collect()
    assert ids(rows) == sorted(last.values()) and set(rows) <= set(kept)

    third = cp.drop_near_copies(spark, second, SF)
    assert third.columns == COLUMNS
    root = brute.near_components([(r.doc_id, r.text) for r in rows], 5, 80)
    left = third.collect()
    assert ids(left) == sorted({c for _, c in root.values()}) and set(left) <= set(rows)

    fourth = cp.mix_sources(spark, third, SF)
    assert fourth.columns == COLUMNS
    mixed = fourth.collect()
    assert set(mixed) <= set(left)
    assert max(mixed.count(r) for r in set(mixed)) <= 3

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    done = cp.encode(spark, fourth, SF).collect()
    want = []
    for r in mixed:
        tokens = library.encode(r.text, add_special_tokens=False).ids
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, tokens)), r.text)]
        want.append((r.doc_id, tokens, len(tokens), *sha))
    assert sorted(map(tuple, done)) == sorted(want)


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    got = cp.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    lorem = " ".join(f"word{rng.randrange(400)}" for _ in range(80))
    rows = [(i, f"the quick brown text number {i} " + lorem[: 60 + 5 * i], "en", "s", 1, 1.0) for i in range(40)]
    rows += [(50, lorem, "en", "s", 1, 2.0), (50, lorem, "en", "s", 1, 2.0), (None, lorem, "en", None, 1, 3.0)]
    rows += [(51, None, "en", "s", 0, 4.0), (52, "", None, None, 0, 5.0), (None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double"
    )


def test_odd_rows_and_extra_columns(spark, odd):
    docs = odd
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        if name != "bpe":
            assert docs.columns == odd.columns
    assert docs.count() > 0
    one = cp.drop_copies(spark, odd, SF)
    assert one.where(F.col("text").startswith("word")).count() == 1
    assert one.where("coalesce(text, '') = ''").count() == 1


def test_no_rows(spark, odd):
    for _, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
