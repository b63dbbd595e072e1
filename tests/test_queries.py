"""Every query with a DuckDB statement gives the same rows on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from trackloom.plans import registry

SF = os.environ.get("TRACKLOOM_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows, order):
    """Rows as sorted texts, columns in the order of their names."""
    one = lambda v: "" if v is None else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLES:
        assert df.columns
        return
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(names)
    by = lambda cols: sorted(range(len(cols)), key=cols.__getitem__)
    assert plain(got, by(df.columns)) == plain(want, by(names))
