"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from credence.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lake():
    connection = duckdb.connect()
    for path in glob.glob(FOLDER + "/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join("∅" if r[i] is None or r[i] != r[i] else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, lake, name):
    frame = contract.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in frame.collect()]
    if name not in catalog.STATEMENTS:
        assert frame.columns
        return
    result = lake.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert lines(frame.columns, rows) == lines(columns, result.fetchall())


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
