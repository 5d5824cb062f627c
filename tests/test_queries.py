"""Every query with SQL against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from voltide.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    for f in glob.glob(f"{medium}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=2e-6, abs_tol=1e-11)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, medium, name):
    df = QUERIES[name](spark, medium)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got
    if name not in ORACLES:
        return
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    keys = [k for k, c in enumerate(cols) if dict(df.dtypes)[c] != "double"]
    order = lambda r: tuple(str(r[k]) for k in keys)
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(close(a, b) for a, b in zip(g, w, strict=True))]
    assert not bad, (len(bad), bad[:3])
    print(name, "exact rows", sum(g == w for g, w in zip(got, want, strict=True)), "of", len(got))
