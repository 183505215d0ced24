"""Named queries against their SQL twins in a second engine.

A few representative queries run by default; ``CLAIMWEAVE_TWINS=all`` (or a comma-separated list) runs others.
"""

import os

import duckdb
import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("CLAIMWEAVE_SF_DIR", "/root/testdata/sf0.01")
DEFAULT = ["verdict_counts", "chunks", "reply_nodes", "anchor_match"]
CHOSEN = os.environ.get("CLAIMWEAVE_TWINS")
NAMES = list(driver.oracle_sql()) if CHOSEN == "all" else CHOSEN.split(",") if CHOSEN else DEFAULT


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for table in ("documents", "orders", "events"):
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def comparable(value):
    return "~" if value is None else repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, engine, name):
    result = engine.execute(driver.oracle_sql()[name])
    names = [column[0] for column in result.description]
    expected = result.fetchall()
    frame = driver.queries()[name](spark, SF_DIR)
    assert sorted(frame.columns) == sorted(names)
    got = frame.select(*names).collect()
    assert sorted(tuple(map(comparable, row)) for row in got) == sorted(tuple(map(comparable, row)) for row in expected)


def test_every_twin_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
