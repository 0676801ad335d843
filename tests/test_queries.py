"""Every registered query of the base library against its SQL twin, and that the rest run."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from timbral.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows_of(columns, rows):
    """Rows as text by ascending column name: nulls and NaN apart, whole numbers as whole numbers."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: "null" if v is None else repr(float(v)) if isinstance(v, (float, Decimal)) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    got = found.collect()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, got) == rows_of(columns, want.fetchall())
