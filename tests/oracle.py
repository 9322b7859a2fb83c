"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import decimal
import math

import duckdb
import numpy as np
import pandas as pd

SF_SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if x is None or x is pd.NaT:
        return None
    if isinstance(x, (np.ndarray, list, tuple)):
        return tuple(_plain(v) for v in x)
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, (float, np.floating)):
        if math.isnan(x):
            return None
        return int(x) if float(x).is_integer() else round(float(x), 6)
    if isinstance(x, np.integer):
        return int(x)
    return x


def rows(names, data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    found = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    wanted = rows(names, cur.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if found == wanted:
        return None
    a, b = set(found) - set(wanted), set(wanted) - set(found)
    return (
        f"{len(found)} rows vs {len(wanted)}; only Spark {len(a)} {sorted(a, key=repr)[:3]}; "
        f"only SQL {len(b)} {sorted(b, key=repr)[:3]}"
    )
