"""Spark result against DuckDB result, as multisets of rows with columns in order of name."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def norm(v):
    return round(v, 9) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


def check(df, con, sql: str) -> int:
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols, (sorted(rel.columns), cols)
    pick = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(map(norm, r)) for r in con.sql(f"SELECT {pick} FROM ({sql})").fetchall()), key=repr)
    got = sorted((tuple(map(norm, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (cols, a, b)
    return len(got)
