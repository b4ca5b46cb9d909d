"""Comparison of a query with its SQL on one scale of the given tables."""

from __future__ import annotations

import glob
import math
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir: str = DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(sf_dir + "/*.parquet"):
        source = path + "/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    if isinstance(v, list):
        return tuple(map(_value, v))
    return v


def rows_of(columns, rows):
    return sorted((tuple(_value(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def assert_same(df, sql: str, sf_dir: str = DATA) -> None:
    cols = sorted(df.columns)
    got = rows_of(cols, df.select(*[f"`{c}`" for c in cols]).collect())
    rel = duck(sf_dir).sql(sql)
    assert sorted(rel.columns) == cols
    want = rows_of(cols, rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert len(got) == len(want)
    assert got == want
