"""Compare a registered query with its SQL text in DuckDB: columns, row count and values."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        return "∅" if value != value else repr(value)
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    got = con.execute(sql)
    want_cols = [d[0] for d in got.description]
    want = rows_of(want_cols, got.fetchall())
    have_cols = spark_df.columns
    have = rows_of(have_cols, [tuple(r) for r in spark_df.collect()])
    if sorted(want_cols) != sorted(have_cols):
        return f"columns {sorted(have_cols)} != {sorted(want_cols)}"
    if len(want) != len(have):
        return f"rows {len(have)} != {len(want)}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]} ({sorted(want_cols)})"
    return None
