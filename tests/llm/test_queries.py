"""Every query of the package that has SQL gives the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

from millrace.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = sorted((tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert sorted(cols) == sorted(df.columns) and got == want
