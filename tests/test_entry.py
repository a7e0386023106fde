import duckdb
import pytest

import __spark_entry__ as e
from sentria.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_entry(spark):
    assert len(e.entry(spark).collect()) == 5


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, tables, name):
    df = e.queries()[name](spark, sf)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    found = tables.execute(e.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())))
    assert got == want
