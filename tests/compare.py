"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(x):
    if x is None:
        return (0, "")
    if isinstance(x, bool):
        return (1, x)
    if isinstance(x, int):
        return (2, x)
    if isinstance(x, float):
        return (0, "") if math.isnan(x) else (3, x + 0.0)
    return (4, type(x).__name__, str(x))


def differences(spark_df, con, sql: str, limit: int = 4) -> list[str]:
    """What differs: column names, row counts, or rows on one side only."""
    names = sorted(spark_df.columns)
    ours = sorted(
        tuple(_cell(r[n]) for n in names) for r in spark_df.select(*[f"`{n}`" for n in names]).collect()
    )
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return [f"columns {names} != {sorted(columns)}"]
    order = [columns.index(n) for n in names]
    theirs = sorted(tuple(_cell(row[i]) for i in order) for row in cur.fetchall())
    out = []
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows != {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    for a, b in bad[:limit]:
        out.append("; ".join(f"{n}: {x} != {y}" for n, x, y in zip(names, a, b) if x != y))
    return out
