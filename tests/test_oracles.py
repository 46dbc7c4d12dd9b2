"""Every query with SQL equals what another engine makes of that SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from claimweave.plans import ORACLES, QUERIES

DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def plain(x):
    if hasattr(x, "as_tuple"):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if x else "0"
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{float(x):.6g}" if x else "0"
    return str(x)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, engine, name):
    got = QUERIES[name](spark, DATA)
    want = engine.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    left = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    right = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall())
    assert left == right
    assert left, "the result is empty"
