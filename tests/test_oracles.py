"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from sparkatlas.plans import catalog

DATA = "/root/testdata/sf0.001"

if not os.path.isdir(DATA):
    pytest.skip("the tables are not there", allow_module_level=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda v: f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(flat(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(name, spark, duck):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0
