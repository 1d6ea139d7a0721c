"""Language by nearest centroid over TF-IDF vectors of letter n-grams.

Letters are lower-cased, everything else counts as one space. Each text is a
vector of its 1- to 3-grams hashed to ``DIMENSIONS``, weighted (1 + log tf) * idf
and normalised. Spherical k-means splits each language of a bounded sample into
``CLUSTERS`` centroids; a text gets the language of the centroid with the largest
cosine, and is rejected if it is much farther from it than nearly all of the
sample was from its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkit

DIMENSIONS = 4096
GRAMS = (1, 2, 3)
CLUSTERS = 4
SAMPLE = 300  # labelled rows a language is learnt from
SHARES = 64  # tasks that choose among the rows of a language
ROUNDS = 12
#: A text is rejected below this fraction of the cosine that 1 % of the sample stays below.
LENIENCE = 0.3
FULL = 100  # different n-grams from which on a text is held to the whole floor
UNDETERMINED = "und"

_SPACE = 32
_BLOCK = 1 << 19  # bytes of text whose vectors are held at a time


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point the lower-case letter, or a space where there is none."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram counts of each text, and whether it has a letter."""
    data, offsets = textkit.flat(column)
    raw = data[offsets[0] : offsets[-1]]
    chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    ends = begun[offsets - offsets[0]]
    n = len(column)
    codes = _letters()[chars]
    row = np.repeat(np.arange(n), np.diff(ends))
    letter = codes != _SPACE
    # a run of others is one space, and a text begins with one
    first = np.zeros(len(codes) + 1, bool)
    first[ends[:-1]] = True
    first = first[:-1]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]
    codes, row = codes[keep].astype(np.uint64), row[keep]
    out = np.zeros(n * DIMENSIONS, np.float32)
    for size in GRAMS:
        m = len(codes) - size + 1
        if m <= 0:
            break
        h = np.full(m, size, np.uint64)
        for j in range(size):
            h = (h * np.uint64(1_000_003) + codes[j : j + m]) & np.uint64(0xFFFFFFFFFFFF)
        slot = (textkit.mix(h) >> np.uint64(40)) % np.uint64(DIMENSIONS)
        whole = row[:m] == row[size - 1 :]
        place = row[:m][whole] * DIMENSIONS + slot[whole].astype(np.int64)
        out += np.bincount(place, minlength=len(out)).astype(np.float32)
    has = np.zeros(n, bool)
    has[row[codes != _SPACE]] = True
    return out.reshape(n, DIMENSIONS), has


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    weight = np.zeros_like(tf)
    np.log(tf, out=weight, where=tf > 0)
    weight[tf > 0] += 1
    return _unit(weight * idf)


@dataclass
class Model:
    """Centroids, the language of each, and the cosine below which a text is rejected."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    floor: np.ndarray

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, its cosine and whether it is rejected, for each text."""
        tf, has = counts(column)
        if not self.languages:
            n = len(column)
            return [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
        cosine = vectors(tf, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
        names = [self.languages[self.of[b]] if h else UNDETERMINED for b, h in zip(best, has, strict=True)]
        # a text of few n-grams cannot come near a centroid of thousands
        reach = np.sqrt(np.minimum(1, (tf > 0).sum(axis=1) / FULL))
        return names, score.astype(float), ~has | (score < self.floor[best] * reach)


def _clusters(x: np.ndarray) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [0]
    while len(seeds) < min(CLUSTERS, len(x)):
        nearest = (x @ x[seeds].T).max(axis=1)
        seeds.append(int(nearest.argmin()))
    centres = x[seeds].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        centres = _unit(
            np.stack(
                [x[own == i].sum(axis=0) if (own == i).any() else c for i, c in enumerate(centres)]
            )
        )
    return centres


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the ``SAMPLE`` labelled rows of each language with the least hashes of their ids.

    Rows with crc32(doc_id) mod 4 = 2, and rows without id, text or label, are
    never learnt from. The rows are chosen by hashes alone, so texts of the
    sample only are read to the driver; the number of languages and ``SAMPLE``
    bound it.
    """
    labelled = (
        docs.select(
            F.col(doc_id).cast("string").alias("id"),
            F.col(text).cast("string").alias("text"),
            F.col(lang).cast("string").alias("lang"),
        )
        .where("id is not null and text is not null and lang is not null")
        .where(F.crc32("id") % 4 != 2)
        .withColumn("h", F.xxhash64("id", "text"))
    )
    # the least of each share of the hashes first, so that no task has all rows of a language
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("h"))
    chosen = labelled.select("lang", "h").distinct().withColumn("share", F.pmod("h", F.lit(SHARES)))
    for by in (("share",), ()):
        chosen = chosen.withColumn("r", rank(*by)).where(F.col("r") <= SAMPLE)
    chosen = chosen.drop("share")
    sample = labelled.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])
    rows = sorted((r.lang, r.r, r.text) for r in sample.collect())
    languages = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0, int), np.zeros(0))
    parts = [counts(pa.array([r[2]])) for r in rows]
    usable = [i for i, (_, has) in enumerate(parts) if has[0]]
    tf = np.concatenate([parts[i][0] for i in usable]) if usable else np.zeros((0, DIMENSIONS), np.float32)
    names = np.array([languages.index(rows[i][0]) for i in usable], int)
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = vectors(tf, idf)
    centroids, of, floor = [], [], []
    for k in sorted(set(names.tolist())):
        mine = x[names == k]
        centres = _clusters(mine)
        near = (mine @ centres.T).max(axis=1)
        centroids.append(centres)
        of += [k] * len(centres)
        floor += [LENIENCE * float(np.quantile(near, 0.01))] * len(centres)
    if not centroids:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0, int), np.zeros(0))
    return Model(languages, idf, np.concatenate(centroids), np.array(of), np.array(floor))


RESULT = ("lang_pred", "score", "rejected")


def classify(
    docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = RESULT
) -> DataFrame:
    """All columns of the rows, with lang_pred, score and rejected, or as ``names`` has it.

    lang_pred is a language of the model, or ``und`` if the text is null or has
    no letter, or if the model knows no language; those are rejected, with score
    0. score is the cosine to the nearest centroid. Texts are read whole, one
    at a time or several, with the same result. Columns of the input that bear a
    name of the result are replaced. No rows give no rows.
    """
    docs = docs.drop(*names)
    schema = T.StructType(
        [
            *docs.schema.fields,
            *map(T.StructField, names, (T.StringType(), T.DoubleType(), T.BooleanType())),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in textkit.groups(batch, text, limit=_BLOCK):
                for at in range(0, part.num_rows, 128):
                    rows = part.slice(at, 128)
                    languages, score, rejected = known.judge(rows.column(text))
                    found = [pa.array(languages, pa.string()), pa.array(score), pa.array(rejected)]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *found], names=schema.names)
        textkit.give_back()

    textkit.whole_texts(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row may not be learnt from; a row without id may not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))
