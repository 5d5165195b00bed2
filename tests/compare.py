"""Run a registered query in Spark and its SQL in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def _plain(value):
    if isinstance(value, float):
        return value if not math.isnan(value) else "NaN"
    if isinstance(value, bool) or value is None:
        return value
    return value if isinstance(value, (int, str)) else str(value)


def difference(df, con, sql) -> str | None:
    """What differs, or None."""
    relation = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} / {sorted(relation.columns)}"
    ours = [tuple(_plain(row[n]) for n in names) for row in df.collect()]
    position = [relation.columns.index(n) for n in names]
    theirs = [tuple(_plain(row[p]) for p in position) for row in relation.fetchall()]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    kinds = {n: ({type(a[i]).__name__ for a in ours} - {"NoneType"}, {type(b[i]).__name__ for b in theirs} - {"NoneType"})
             for i, n in enumerate(names)}
    for n, (a, b) in kinds.items():
        if a != b:
            return f"type of {n}: {a} / {b}"
    bad = [(a, b) for a, b in zip(_sorted(ours), _sorted(theirs), strict=True) if a != b]
    return f"{len(bad)} rows, e.g. {names}: {bad[0]}" if bad else None
