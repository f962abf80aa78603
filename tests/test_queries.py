"""Every registered query against its SQL on the smallest tables."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest

from scriptorium.plans import checks, graph_checks, more_checks, record_checks  # noqa: F401  (these add their queries to the registry)
from scriptorium.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, (dt.datetime, dt.date)) else v


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    columns = sorted(df.columns)
    if name not in ORACLE_SQL:
        return
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and set(ORACLE_SQL) <= set(QUERIES)
