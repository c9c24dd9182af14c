"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from assayer.plans import load
from check import TABLES, norm, rows

QUERIES, ORACLES = load().QUERIES, load().ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_registry_is_whole():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == {"tx_rouge_l"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = ORACLES.get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert not [c for c in cur.description if "HUGEINT" in str(c[1]) or "DECIMAL" in str(c[1])]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_norm_keeps_signless_zero():
    assert norm(-0.0) == 0.0
