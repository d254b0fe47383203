"""Every query against the DuckDB SQL that says the same, row by row, on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from tallyforge.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    mine = registry.QUERIES[name](spark, SF)
    theirs = duck.sql(registry.ORACLES[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())
