import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.classify(docs, model).where(L.held_out()).select("lang", "lang_pred", "score", "rejected").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.002 * len(rows)


def test_never_learns_from_held_out_rows(spark):
    docs = spark.createDataFrame(
        [(i, "aaa bbb" if zlib.crc32(str(i).encode()) % 4 == 2 else "ccc ddd", "x" if zlib.crc32(str(i).encode()) % 4 == 2 else "y") for i in range(60)],
        "doc_id long, text string, lang string",
    )
    assert L.learn(docs).languages == ["y"]
    flags = {r[0]: r[1] for r in docs.select("doc_id", L.held_out()).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(60)}


def test_rows_are_judged_alone(model):
    texts = ["The onoued thereati", "x", None, "", "123 !!", "Ñez cióntaó", "ẞÜÖ İ ǅ", "der die und" * 500]
    together = model.judge(pa.array(texts))
    alone = [model.judge(pa.array([t], pa.string())) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert together[1] == pytest.approx([a[1][0] for a in alone], abs=1e-5)
    assert [n == "und" for n in together[0]] == [False, False, True, True, True, False, False, False]
    assert together[2][2:5].all() and not together[2][7]


def test_far_texts_are_rejected(model):
    names, _, rejected = model.judge(pa.array(["зжш щюя чцх " * 20, "漢字仮名交文" * 20, "qzx wvk jjq zzq xqw kvz " * 10]))
    assert rejected.all() and set(names) <= set(model.languages)


def test_odd_rows(spark, model):
    docs = spark.createDataFrame(
        [(None, None, "en", 1.0), (1, "", None, 2.0), (2, "the and of", "de", 3.0), (2, "the and of", "de", 3.0)],
        "doc_id long, text string, lang string, score double",
    )
    got = L.classify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    rows = sorted(got.collect(), key=lambda r: r.doc_id or 0)
    assert [r.lang_pred for r in rows] == ["und", "und", "en", "en"]
    assert L.classify(docs.limit(0), model).count() == 0
    assert docs.where("doc_id is null").select(L.held_out()).first()[0]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    rows = L.classify(docs, L.learn(docs)).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in rows} == {("und", 0.0, True)}


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 5)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("wort "), "id").alias("text"), F.lit("de").alias("lang"))
    model = L.learn(docs)
    assert model.languages == ["de"] and len(model.centroids) <= L.CLUSTERS
