"""Every catalogue query with oracle SQL gives the oracle's rows on the smallest tables."""

import math
import os

import pytest

from lodestar.plans import catalogue, crawling, harvesting, more, reading, review, verdicts  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    want = oracle.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    place = [want.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=str)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert set(catalogue.QUERIES) <= set(q)
