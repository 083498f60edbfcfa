"""Every core query with SQL against DuckDB on the small tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from lodeworks import catalogue

SF = os.environ.get("LODEWORKS_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v) if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = catalogue.oracles().get(name)
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
