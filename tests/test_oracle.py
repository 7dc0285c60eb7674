"""Every query against its DuckDB statement; ``ORACLE_SF_DIR`` picks the tables."""

import os

import pytest

import __spark_entry__ as driver
from oracle import connect, difference

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert difference(driver.queries()[name](spark, FOLDER), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_no_oracle_is_empty(con, name):
    assert con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(ORACLES)))
def test_rows_only(spark, name):
    assert driver.queries()[name](spark, FOLDER).limit(1).count() == 1


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert {r.view for r in rows} == {"clean", "web", "hard"}
