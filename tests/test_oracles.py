"""Every query with SQL against DuckDB on the smallest tables; every query runs."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import load_catalog

CATALOG = load_catalog()
SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


def canonical(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(value, v)) + "]"
        try:
            return f"{float(v):.9g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    columns = sorted(df.columns)
    return sorted(tuple(value(v) for v in row) for row in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CATALOG.ORACLES))
def test_oracle(spark, con, name):
    ours = CATALOG.QUERIES[name](spark, SF)
    want = con.execute(CATALOG.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(want.columns)
    got = ours.toPandas()
    assert len(got) == len(want)
    a, b = canonical(got), canonical(want)
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)


@pytest.mark.parametrize("name", sorted(set(CATALOG.QUERIES) - set(CATALOG.ORACLES)))
def test_runs(spark, name):
    assert CATALOG.QUERIES[name](spark, SF).count() >= 0
