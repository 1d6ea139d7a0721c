"""Each query over its whole tables; where SQL can say it, against DuckDB."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple(str(x) for x in r) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    mine = df.select(*names).collect()
    assert mine and plain(mine) == plain(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
