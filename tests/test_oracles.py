"""Every registered query against its SQL on the small tables."""

import os
from pathlib import Path

import duckdb
import pytest

from ledgerlark.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted([tuple(str(plain(r[i])) for i in order) for r in data])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got[1]
        return
    cur = duck.execute(ORACLES[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got == want


def test_pages_as_their_sql(spark, tmp_path):
    """Entities without a semicolon, numbers, other names and blanks beyond ASCII, which the SQL leaves alone."""
    pages = ["and&amp <b>so", "&amp;quot; &quot;&copy;&middot;&copy", "&#38; &#x26; &eacute; &nbsp; x", "\xa0a\xa0b<br>\u2003c \x0b<p>d</p>d</p>&ampx;", "&&amp;&", "<p>a &amp</p>\r\n<p>a &amp</p>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("clean_text_pages", "page_text"):
        df = QUERIES[name](spark, str(tmp_path))
        cur = con.execute(ORACLES[name])
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())
