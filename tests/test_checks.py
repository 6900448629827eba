"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from checks import all_checks

SF_DIR = "/root/testdata/sf0.001"
TABLES = "conversations customer documents embeddings events benchmark labels lineitem orders pages"
ORACLES = sorted(all_checks()[1])

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


def plain(value):
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, sql, name):
    queries, oracles = all_checks()
    df = queries[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    cur = sql.execute(oracles[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall())
    assert got == want and got


def test_every_query_has_sql_or_says_why():
    queries, oracles = all_checks()
    assert all(queries[n].__doc__ for n in set(queries) - set(oracles))
