"""Every named query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidebarge.bindings import ORACLES, QUERIES, TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def canon(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("" if v is None or v != v else repr(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1000
