"""A training-data pipeline over documents: five stages, each a Spark job on the one before.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all
but the last return the columns of documents. Between stages the rows are
written as Parquet to the shared folder and read again. Rows with null or
repeated ids, null texts and extra columns pass through as the operators'
docstrings say; no rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, language, mixing, near_dedup
from tidemark.llm.workspace import Workspace, held

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows among them teach; far texts go."""
    names = ("_lang_pred", "_lang_score", "_lang_rejected")
    judged = language.classify(docs, language.learn(docs), names=names)
    return judged.where(~F.col(names[2])).drop(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share four fifths of their five-word shingles."""
    found = near_dedup.near_duplicates(docs, shingle_words=5, percent=80)
    # rows equal in id and mark stay or go together, so the few that go name themselves
    gone = found.where("not kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    gone = held(Workspace(spark, "gone").write(gone.distinct(), "gone"))
    rows = docs.withColumn("_own_mark", near_dedup.mark())
    same = rows["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (rows["_own_mark"] == gone["_mark"])
    return rows.join(gone, same, "left_anti").drop("_own_mark")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    mixed = mixing.mix(docs, columns=docs.columns).where("mix_copies > 0")
    return mixed.withColumn(
        "mix_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    ).drop(*mixing.RESULT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row that the mix takes."""
    done = bpe.encode_digests(docs, VOCABULARY, keep_ids=True)
    return done.select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: Language, sketches and multipliers are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.write(docs, name)
    return docs
