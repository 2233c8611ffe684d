"""Every registered query of the main part against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillflow.plans.registry import load

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name not in ORACLES:
        assert df.count() > 0
        return
    found = duck.execute(ORACLES[name])
    columns = sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(c) for c in columns]
    wanted = sorted(tuple(cell(row[k]) for k in order) for row in found.fetchall())
    assert columns == sorted(df.columns)
    assert sorted(tuple(map(cell, row)) for row in df.select(*columns).collect()) == wanted
