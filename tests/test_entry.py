import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tidemerge.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(x):
    return int(x) if isinstance(x, bool) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_equals_sql(spark, oracle, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = oracle.sql(contract.oracle_sql()[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr) == expected


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert contract.entry(spark).count() >= 0
