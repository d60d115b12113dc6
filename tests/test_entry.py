import duckdb
import pytest

import __spark_entry__ as entry
from skein.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
