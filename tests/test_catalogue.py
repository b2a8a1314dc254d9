"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from foliant.plans import catalogue


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, oracle, name, tmp_path):
    df = catalogue.queries()[name](spark, sf)
    out = str(tmp_path / "out")
    df.write.parquet(out)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got = duckdb.connect().execute(f"SELECT {columns} FROM '{out}/*.parquet'").fetchall()
    if name in catalogue.oracle_sql():
        want = oracle.execute(f"SELECT {columns} FROM ({catalogue.oracle_sql()[name]})").fetchall()
        key = lambda rows: sorted((tuple(map(_norm, r)) for r in rows), key=repr)
        assert key(got) == key(want)
    else:
        assert got or name == "fuzzy_ratio_join"  # few part names are alike in the smallest table
