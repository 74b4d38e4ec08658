"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return v


@pytest.mark.skipif(not Path(SF).exists(), reason="tables are not there")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"logistic_heads", "cross_validation", "fused_heads"}))  # whole model zoos: test_audits and test_heads have their parts
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    if name in registry.SQL:
        rel = duck.execute(registry.SQL[name])
        cols = [c[0] for c in rel.description]
        assert sorted(cols) == sorted(df.columns)
        order = [cols.index(c) for c in sorted(cols)]
        assert got == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    else:
        assert got
