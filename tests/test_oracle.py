"""Every query outside the llm subpackage against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from textloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(found):
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in found)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = rows(df.select(*names).collect())
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    assert got == rows(duck.sql(f"SELECT {', '.join(f'{chr(34)}{n}{chr(34)}' for n in names)} FROM ({registry.ORACLES[name]})").fetchall())


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
