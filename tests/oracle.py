"""Rows of a query and of its SQL in DuckDB, in a form that can be compared."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 6)
    return x


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(repr([plain(x) for x in r]) for r in frame[names].astype(object).itertuples(index=False))


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return rows(con.execute(sql).df())
