"""Every query with SQL gives the rows DuckDB gives."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quaver.plans import catalog


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return round(float(v), 5)
    try:
        return round(float(v), 5) if type(v).__name__ == "Decimal" else str(v)
    except ValueError:
        return str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, sf, duck, name):
    want = duck.execute(catalog.ORACLE[name]).df()
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
