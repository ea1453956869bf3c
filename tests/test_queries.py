"""Every registered query runs, and equals its SQL where SQL can express it."""

import pytest

import __spark_entry__ as entry_points
from checks import compare
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 173 and "stddev_dhdr_iva_receptor" in df.columns


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    line, fine = compare.compare(spark, duck, SF, name, entry_points.queries()[name], SQL.get(name))
    assert fine, line
