import os

from tidemark import session


def test_scratch_is_cleared_and_only_that(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_scratch", [])
    table = session.written(spark.range(3), "mine")
    (path,) = session._scratch
    assert table.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    (tmp_path / "other").mkdir()
    assert session.clear_scratch(spark) == 1
    assert not os.path.exists(path.removeprefix("file:")) and (tmp_path / "other").is_dir()
    assert session.clear_scratch(spark) == 0
