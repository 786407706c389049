"""Run queries beside their SQL and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    if type(x).__name__ == "Decimal":
        return plain(float(x))
    return x


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def difference(spark, name: str, f, sql: str, sf_dir: str) -> str:
    got = f(spark, sf_dir)
    mine = rows_of(got.columns, got.collect())
    rel = connect(sf_dir).execute(sql)
    names = [c[0] for c in rel.description]
    other = rows_of(names, rel.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"{name}: columns {sorted(got.columns)} and {sorted(names)}"
    if len(mine) != len(other):
        return f"{name}: {len(mine)} rows and {len(other)}"
    bad = [(a, b) for a, b in zip(mine, other, strict=True) if a != b]
    return f"{name}: {len(bad)} rows differ, such as {bad[0]}" if bad else ""
