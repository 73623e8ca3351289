"""Every registered query against its reference SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import cell
from tracetally.plans.derived import BASE

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in ORACLES:
        assert got
        return
    rel = duck.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want
