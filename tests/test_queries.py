"""Every registered query against its SQL on the smallest given tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from ampliframe.plans import queries as registered

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def comparable(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(None if pd.isna(v) else v for v in r)
                   for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = registered.QUERIES[name](spark, SF).toPandas(), duck.execute(registered.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours) == comparable(theirs)


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["sample_id", "taxon", "frequency", "share"]
    assert result.count() > 0
