"""Every registered query of the engine against DuckDB on the same tables."""

import os

import duckdb
import pytest

from mnemospark import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Held against versions in plain Python: test_retrieval, test_planning.
NO_SQL = {"history_retrieval", "history_recall", "managed_plan", "project_evidence", "artifact_report"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows, columns):
    def cell(x):
        return round(x, 6) if isinstance(x, float) else tuple(map(cell, x)) if isinstance(x, list) else x

    return sorted((tuple(cell(r[c]) for c in columns) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if name in NO_SQL:
        assert rows and not sql
        return
    assert sql, f"{name} has no SQL"
    got = duck.execute(sql)
    columns = [d[0] for d in got.description]
    want = [dict(zip(columns, r)) for r in got.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    assert plain(rows, sorted(columns)) == plain(want, sorted(columns))
