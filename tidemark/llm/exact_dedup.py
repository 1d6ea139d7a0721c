"""Exact duplicates by progressive refinement: length, then prefix, then the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace, held

PREFIX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str = "text") -> Column:
    """The text with A-Z, and nothing else, in lower case; null counts as empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)


def copies(docs: DataFrame, doc_id: str = "doc_id", prefix: int = PREFIX) -> DataFrame:
    """(text_sha256, keep_id, group_size, keep_rows) of every text that several rows share.

    Each step counts the rows of a key and lets only keys of several rows go on:
    first the length, then the length and the hash of the first ``prefix``
    characters, then the digest of the whole text. The first two steps share one
    aggregate over (length, hash), so a key with a third of all rows is one row
    before anything is joined; only rows that survive both are sent and read
    whole. keep_id is the largest doc_id of a group, null if all are, and keep_rows
    how many rows bear it.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised().alias("t"))
    rows = rows.withColumns(
        {"size": F.octet_length("t"), "head": F.xxhash64(F.substring("t", 1, prefix))}
    )
    counts = rows.groupBy("size", "head").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("size").agg(F.sum("c").alias("of_size")).where("of_size > 1")
    heads = counts.where("c > 1").join(sizes, "size", "left_semi").select("size", "head")
    # never null, and said so: else the digest of every row is tested before the join
    digest = F.coalesce(F.sha2(F.col("t"), 256), F.lit(""))
    return (
        rows.join(heads, ["size", "head"], "left_semi")
        .groupBy(digest.alias("text_sha256"), "doc_id").agg(F.count("*").alias("n"))
        .groupBy("text_sha256")
        .agg(
            F.max("doc_id").alias("keep_id"),
            F.sum("n").alias("group_size"),
            F.max(F.struct("doc_id", "n"))["n"].alias("keep_rows"),
        )
        .where("group_size > 1")
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", prefix: int = PREFIX) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of equal texts.

    The row with the largest doc_id stays. Of rows repeated with that id one
    stays; which one is not defined if they differ in other columns. The groups
    are found from ids and texts, and rows meet their digests only: as long as
    they are few, the rows themselves are not sent.
    """
    digest, kept = "_text_sha256", "_keep_id"
    ws = Workspace(docs.sparkSession, "exact")
    groups = ws.write(
        copies(docs, doc_id, prefix).select(
            F.col("text_sha256").alias(digest), F.col("keep_id").alias(kept), F.col("keep_rows").alias("_keep_rows")
        ),
        "copies",
    )
    rows = docs.withColumn(digest, F.sha2(normalised(), 256))
    own = F.col(doc_id).cast("long")
    found = rows.join(held(groups), digest, "left")
    stay = found.where(F.col("_keep_rows").isNull() | (F.col("_keep_rows") == 1) & own.eqNullSafe(F.col(kept)))
    repeated = groups.where("_keep_rows > 1")
    if not repeated.isEmpty():
        same = rows.join(held(repeated), digest).where(own.eqNullSafe(F.col(kept)))
        stay = stay.unionByName(same.dropDuplicates([digest]))
    return stay.select(*docs.columns)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", prefix: int = PREFIX) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too.

    Texts are equal if identical after lower-casing A-Z; null equals empty. The
    row with the largest doc_id of its group stays. Rows repeated with one
    doc_id are one group whose rows are all kept, since they are the same row;
    a null doc_id is kept only if its whole group has none. Other columns are
    not read. No rows give no rows.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.sha2(normalised(), 256).alias("text_sha256")
    )
    ws = Workspace(docs.sparkSession, "exact")
    groups = ws.write(copies(docs, doc_id, prefix).drop("keep_rows"), "copies")
    found = rows.join(held(groups), "text_sha256", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
