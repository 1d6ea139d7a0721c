"""The operators over the driver's tables, each applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, conversations, hnsw, html_extract, language, toxicity, url_filter
from tidemark.llm.bpe import encode_digests
from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.line_dedup import repeated_lines
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.substring_dedup import passage_classes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op7_line_dedup_minhash")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(_table(spark, sf_dir, "documents")).drop("mark", "keep_mark")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: (verdict, host, path)
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


@_query("op1_substring_windows")
def substring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of those it shares passages with, and its repeated stretches."""
    return passage_classes(_table(spark, sf_dir, "documents"))


@_query("op2_html_blocks")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.learn(pages))


@_query("op3_ann_hnsw")
def ann_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@_query("op4_mix_entropy")
def mix_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


@_query("op5_language_centroids")
def language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.learn(docs)
    return language.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


@_query(
    "op6_exact_dedup_refined",
    f"""SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents)
    WINDOW same AS (PARTITION BY t)""",
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


@_query(
    "op8_url_rules",
    f"""WITH r(verdict, h, p) AS (VALUES {", ".join(map(str, URL_RULES))}),
    a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
      THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
    c AS (SELECT page_id, translate(raw, {_AZ}) AS host,
      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
    d AS (SELECT page_id, host, path, max({{'n': length(h || p), 'rule': h || p, 'v': verdict}}) AS m
      FROM c LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      GROUP BY ALL)
    SELECT page_id, host, path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict FROM d""",
)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@_query("op10_near_dedup_setsketch")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return near_duplicates(docs, shingle_words=2, percent=80).drop("mark")


@_query("op9_bpe_tree")
def bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return encode_digests(_table(spark, sf_dir, "documents"), vocabulary)


@_query("op12_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


@_query("op13_toxicity_subwords")
def toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted"
    )


@_query("op11_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(_table(spark, sf_dir, "documents"), first, second)
