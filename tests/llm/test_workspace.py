from pyspark.sql import functions as F

from tidemark.llm import workspace


def test_tables_are_written_once_and_dropped(spark):
    ws = workspace.Workspace(spark, "t")
    table = ws.write(spark.range(5).withColumn("x", F.rand()), "x")
    assert sorted(table.collect()) == sorted(table.collect())
    ws.drop(table)
    assert not spark.sparkContext._jvm.java.io.File(table._workspace_path.removeprefix("file:")).exists()


def test_keys_are_broadcast_only_when_few(spark, monkeypatch):
    rows, keys = spark.range(100), spark.range(0, 100, 7)
    few = rows.join(workspace.held(keys), "id", "left_semi")
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 3)
    many = rows.join(workspace.held(keys), "id", "left_semi")
    assert sorted(few.collect()) == sorted(many.collect())
    assert "strategy=broadcast" in few._jdf.queryExecution().toString()
    assert "strategy=broadcast" not in many._jdf.queryExecution().toString()
