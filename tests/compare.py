"""Run a query on Spark and its SQL on DuckDB over the same tables and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from '{files}'")
    return con


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)) or type(x).__name__ in ("Row", "ndarray"):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if type(x).__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    return x


def rows_of_spark(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)


def rows_of_duck(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
