import os

import duckdb
import pytest

import __spark_entry__ as entry
from skein.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canon(rows):
    return sorted(tuple(repr(v) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_oracle(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [list(want.columns).index(c) for c in cols]
    got = canon(tuple(r) for r in df.select(*cols).collect())
    assert got == canon(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and row[0]["perplexity"] > 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
