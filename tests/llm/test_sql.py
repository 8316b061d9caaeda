"""Queries against their SQL on the small tables."""

import os
from pathlib import Path

import duckdb
import pytest

from ledgerlark.llm import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(oracles.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(c[0] for c in cur.description)
    order = [[c[0] for c in cur.description].index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(float(r[i]) if c == "containment" else r[i] for c, i in zip(cols, order, strict=True))) for r in cur.fetchall())
