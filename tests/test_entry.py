"""The driver's contract: all core queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from topicweave.plans import queries as core

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    df = core.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = db.sql(core.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect()) == sorted(repr(plain(tuple(r[i] for i in at))) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_do_not_need_the_extra_package():
    import pathlib

    root = pathlib.Path(core.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "topicweave.llm" in p.read_text()]
