import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import textkit, toxicity

SF = "/root/testdata/sf0.1"


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 0xFFFF else " " for c in text.lower()).split()


def plain_features(text):
    """The buckets from strings, a word and an n-gram at a time."""

    def bucket(codes, seed):
        h = 0
        for c in codes:
            h = (h * int(toxicity._BASE) + c) % 2**64
        return int(textkit.mix(np.array([h], np.uint64) * toxicity._SEEDS[seed])[0]) % toxicity.BUCKETS

    out = Counter()
    for w in words(text):
        marked = [0, *map(ord, w), 0]
        for size in toxicity.SIZES:
            for i in range(len(marked) - size + 1):
                out[bucket(marked[i : i + size], size % 8)] += 1
        # the whole word is hashed from its end
        out[bucket([*map(ord, reversed(w)), 0], 0)] += 1
    return out


def test_features_are_words_and_their_n_grams():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abE é1.,\n*Ünß中🙂") for _ in range(rng.randrange(0, 60)))
        assert Counter(toxicity.features(text).tolist()) == plain_features(text)


def test_long_texts_are_read_whole_in_pieces():
    text = "some words and more " * 60_000
    parts = list(toxicity.pieces(text))
    assert len(parts) > 3 and "".join(parts) == text
    assert "".join(toxicity.pieces("x" * 1_500_000)) == "x" * 1_500_000
    whole = sum((Counter(toxicity.features(p).tolist()) for p in parts), Counter())
    assert whole == Counter(toxicity.features(text).tolist())


def invented(seed, n):
    """Texts of made-up words; the toxic ones hold insults, some with a letter changed."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = rng.choices(vocabulary, k=rng.randrange(15, 80))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(2 + len(text) // 20):
                text.insert(rng.randrange(len(text)), rng.choice(["wretchling", "scoundrelly", "vermincrawl"]))
        rows.append((seed * 100_000 + i, " ".join(text), toxic))
    return rows, vocabulary


@pytest.fixture(scope="module")
def taught(spark):
    rows, vocabulary = invented(3, 1500)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.learn(df.drop("toxic"), df.drop("text")), vocabulary


def test_unseen_misspellings_share_n_grams(taught):
    model, vocabulary = taught
    rng = random.Random(9)
    caught = clean = 0
    for _ in range(100):
        text = rng.choices(vocabulary, k=30)
        clean += toxicity.score_text(model, " ".join(text)) < 0.5
        text[3:6] = ["wretchlin9", "sc0undrelly", "vermincrawI"]
        caught += toxicity.score_text(model, " ".join(text)) >= 0.5
    assert caught >= 95 and clean >= 95


def test_accuracy_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    scored = toxicity.classify(docs.select("doc_id", "text"), model).drop("text")
    rows = scored.join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    of = {c: [r.predicted for r in rows if r.toxic == c] for c in (0, 1)}
    assert np.mean(of[1]) > 0.8 and np.mean(of[0]) < 0.04
    # the same model and scores again
    again = toxicity.learn(docs, labels)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, _ = invented(4, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    flipped = df.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.learn(df.drop("toxic"), x.drop("text"), sample=50) for x in (df, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_nulls_repeats_empty_and_clashing_columns(spark, taught):
    model, _ = taught
    texts = [None, "", " .,! ", "wretchling", "WRETCHLING!", "ba " * 400_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2 + [(None, "ba")], "doc_id long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("score", "toxic", "_key", "ids", "te`xt")})
    out = toxicity.classify(df.withColumnRenamed("te`xt", "other"), model)
    assert set(out.columns) == {"doc_id", "text", "toxic", "_key", "ids", "other", "score", "predicted"}
    rows = out.collect()
    assert len(rows) == 13
    by = {r.doc_id: r.score for r in rows}
    nothing = 1 / (1 + np.exp(-model.bias))
    assert by[0] == by[1] == by[2] == pytest.approx(nothing)
    assert by[3] == by[4] > 0.5 > by[5]
    assert by[None] == pytest.approx(by[5])
    # null labels and ids, contradicting labels, labels of no document
    labels = spark.createDataFrame([(None, 1), (2, None), (3, 0), (3, 1), (77, 1), (4, 0)], "doc_id long, toxic int")
    assert 0 < toxicity.score_text(toxicity.learn(df, labels), "wretchling") < 1


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert toxicity.score_text(model, "any") == 0.5
    assert toxicity.classify(docs, model).count() == 0
