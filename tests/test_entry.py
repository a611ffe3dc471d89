import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tanglaw import queries as core


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return [plain(v) for v in value] if isinstance(value, list) else value


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, data, con, name):
    df = core.queries()[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    cursor = con.execute(core.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    theirs = sorted([tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()], key=str)
    assert ours == theirs


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(core.queries()) > 100 and len(core.oracle_sql()) > 90


def test_entry(spark):
    assert entry.entry(spark).count() > 0
