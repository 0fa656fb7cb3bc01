"""Compare registered queries with their SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import glob
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = [tuple(None if isinstance(r[i], float) and r[i] != r[i] else r[i] for i in order) for r in values]
    return sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if columns and rows are the same, else the first difference."""
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, got = rows(names, result.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return f"{len(got)} rows, {len(want)} by SQL"
    for a, b in zip(got, want, strict=True):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return ""


def data(name: str = "sf0.01") -> str:
    return str(Path("/root/testdata") / name)


__all__ = ["data", "differences", "duck", "glob"]
