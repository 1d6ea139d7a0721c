"""Toxicity from subword bags: embeddings averaged over a text, into a linear softmax.

The features of a text are its words and their character n-grams, with marks at
both ends of a word, hashed to BUCKETS vectors. Vectors and softmax are trained
together in numpy, so a spelling that was never seen is judged by the n-grams it
shares. Averages are linear, so a trained model scores a feature by one number
and a text by the mean of its features' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit

BUCKETS = 1 << 18
SIZE = 4  # numbers of a vector
SIZES = (4, 5, 6)  # characters of an n-gram, the marks included
SAMPLE = 3000  # labelled rows of a class to learn from, at most
ROUNDS, BATCH = 8, 16
RATE, REACH = 200_000.0, 0.3  # a step's length, and how far it may move the log-odds of its own text, about
LEAST_SHARE = 0.2  # what the rarer class weighs at least
PIECE = 1 << 18  # characters whose features are made at a time

_RANDOM = np.random.default_rng(13)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = _RANDOM.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Model:
    """What a feature adds to the log-odds of a text, and the log-odds of no features."""

    weights: np.ndarray
    bias: float


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no label is learnt from: the checksum of the id leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


# features


@lru_cache(maxsize=1)
def _inside() -> np.ndarray:
    """Which of the first 65,536 characters belong to words; all others do."""
    return np.array([chr(i).isalnum() for i in range(1 << 16)])


def _characters(text: str) -> np.ndarray:
    """The characters of the words in lower case, a 0 before and after each word."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.ones(len(chars), bool)
    low = chars < 1 << 16
    word[low] = _inside()[chars[low]]
    out = np.zeros(len(chars) + 2, np.uint64)
    out[1:-1] = np.where(word, chars, 0)
    keep = out > 0
    keep[0] = True
    keep[1:] |= out[:-1] > 0  # of marks in a row the first
    return out[keep]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def features(text: str) -> np.ndarray:
    """The buckets of a text's words and n-grams, repeats included."""
    chars = _characters(text)
    n = len(chars)
    if n < 3:
        return np.empty(0, np.int64)
    solid = chars > 0
    found = []
    for size in SIZES:
        if n < size:
            continue
        hashes = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            hashes = hashes * _BASE + chars[j : n - size + 1 + j]
        whole = np.ones(len(hashes), bool)
        for j in range(1, size - 1):  # marks stand only at the ends
            whole &= solid[j : n - size + 1 + j]
        found.append(textkit.mix(hashes[whole] * _SEEDS[size % 8]))
    marks = np.flatnonzero(~solid)
    powers = _powers(int(np.diff(marks).max()))
    place = np.arange(n) - np.repeat(marks, np.diff(np.append(marks, n)))
    words = np.add.reduceat(chars * powers[place % len(powers)], marks[:-1])
    found.append(textkit.mix(words * _SEEDS[0]))
    return (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that end at a space, so that a long one needs little memory."""
    at = 0
    while at < len(text):
        to = text.find(" ", at + PIECE)
        to = len(text) if to < 0 or to > at + 2 * PIECE else to
        to = min(to, at + 2 * PIECE)
        yield text[at:to]
        at = to


# learning


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the buckets and their counts; a bag is bounded by BUCKETS."""
    squeeze = zstandard.ZstdCompressor().compress
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            counts = np.zeros(BUCKETS, np.int64)
            for piece in pieces(text or ""):
                counts += np.bincount(features(piece), minlength=BUCKETS)
            ids = np.flatnonzero(counts)
            bag = np.concatenate([np.diff(ids, prepend=0), counts[ids]])
            yield pa.record_batch(
                {
                    "_key": batch.column("_key").slice(i, 1),
                    "toxic": batch.column("toxic").slice(i, 1),
                    "bag": pa.array([squeeze(bag.astype(np.int64).tobytes())], pa.binary()),
                }
            )


def _opened(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a bag and their shares."""
    steps, counts = np.frombuffer(zstandard.decompress(bag), np.int64).reshape(2, -1)
    return np.cumsum(steps).astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled documents that are not held out.

    Of each class the ``sample`` documents with the least hashes of their ids
    are read, whole; the classes weigh as they do among all labels, the rarer
    one at least LEAST_SHARE. A document
    is toxic if any label of its id says so; null ids and labels teach nothing,
    and of rows with one id, one. With a class missing, the score of every text
    is the share of the other.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("_key"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("_key").isNotNull() & F.col("toxic").isNotNull() & ~held_out("_key"))
        .groupBy("_key").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    empty = Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    if len(sizes) < 2:
        return empty
    least = [
        known.where(F.col("toxic") == c).orderBy(F.xxhash64("_key"), "_key").limit(sample) for c in (0, 1)
    ]
    texts = docs.select(F.col("doc_id").cast("long").alias("_key"), F.col("text").cast("string").alias("text"))
    chosen = F.broadcast(least[0].union(least[1]))  # no more than twice the sample
    rows = (
        texts.join(chosen, "_key")
        .mapInArrow(_bags, "_key long, toxic int, bag binary")
        .dropDuplicates(["_key"]).orderBy("_key").toArrow()
    )
    y = rows.column("toxic").to_numpy()
    if len(set(y)) < 2:
        return empty
    bags = [_opened(x.as_py()) for x in rows.column("bag")]
    return _train(bags, y, float(np.clip(share, LEAST_SHARE, 1 - LEAST_SHARE)))


def _train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: float) -> Model:
    """Vectors and softmax together, by descent on the cross entropy in batches.

    The toxic rows weigh ``share`` of all. A mean over few features moves far
    with a step, so the step of a text is bounded by the squares of its shares.
    """
    rng = np.random.default_rng(1)
    table = rng.normal(0, 0.1, (SIZE, BUCKETS))
    out = rng.normal(0, 0.5, (SIZE, 2))
    out /= np.linalg.norm(out[:, 1] - out[:, 0])
    bias = np.log(np.array([1 - share, share]))
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    farthest = REACH / np.array([max(1e-12, float(p @ p)) for _, p in bags])
    last = ROUNDS * -(-len(y) // BATCH)
    for step in range(last):
        if step % (last // ROUNDS) == 0:
            order = rng.permutation(len(y))
        at = step % (last // ROUNDS) * BATCH
        rows = order[at : at + BATCH]
        flat = np.concatenate([bags[r][0] for r in rows]).astype(np.int64)
        part = np.concatenate([bags[r][1] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
        mean = np.stack([np.bincount(row, v[flat] * part, len(rows)) for v in table], 1)
        logits = mean @ out + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), y[rows]] -= 1
        p *= weight[rows, None]
        reach = np.minimum(RATE * (1 - step / last) / len(rows), farthest[rows])
        back = (p * reach[:, None]) @ out.T
        for d in range(SIZE):
            table[d] -= np.bincount(flat, back[row, d] * part, BUCKETS)
        out -= 0.02 * (mean.T @ p) / len(rows)
        bias -= 0.02 * p.mean(axis=0)
    return Model((out[:, 1] - out[:, 0]) @ table, float(bias[1] - bias[0]))


# scoring


def score_text(model: Model, text: str | None) -> float:
    """The probability of the toxic class; that of no features for an empty text."""
    total, n = 0.0, 0
    for piece in pieces(text or ""):
        found = features(piece)
        total += float(model.weights[found].sum())
        n += len(found)
    odds = model.bias + total / max(1, n)
    return float(1 / (1 + np.exp(-odds))) if odds >= 0 else float(np.exp(odds) / (1 + np.exp(odds)))


def classify(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the score of each whole text and 1 where it is at least a half.

    ``docs`` has a column text and keeps all its columns but those of ``names``;
    null and empty texts, and texts without letters and digits, get the score of
    a text without features. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in names]
    frame = docs.select(*kept, F.col("text").cast("string").alias("_scored_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = np.array([score_text(known, t) for t in batch.column("_scored_text").to_pylist()], float)
            columns = {c: batch.column(i) for i, c in enumerate(kept)}
            columns[names[0]] = pa.array(scores, pa.float64())
            columns[names[1]] = pa.array((scores >= 0.5).astype(np.int32))
            yield pa.record_batch(columns)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return frame.mapInArrow(run, f"{kinds}, `{names[0]}` double, `{names[1]}` int")
