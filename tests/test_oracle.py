"""Every registered query against its DuckDB oracle (order-insensitive value hash)."""

import re

import pytest

import __spark_entry__ as E
from feeds import SF_SMALL
from tools.oracle_check import digest, duck_conn

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_conn(SF_SMALL)


def test_every_query_has_an_oracle():
    missing = sorted(q for q in set(QUERIES) - set(ORACLE) if q != "pipeline" and not re.match(r"op\d+_", q))
    assert missing == []


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    h1, l1 = digest(df.columns, rows)
    h2, l2 = digest(dcols, drows)
    assert h1 == h2, (sorted(set(l1) - set(l2))[:3], sorted(set(l2) - set(l1))[:3])
