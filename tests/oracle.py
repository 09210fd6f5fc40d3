"""Compares a query's rows with its DuckDB SQL, as values without order."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if x is None or (not isinstance(x, (list, np.ndarray, dict)) and pd.isna(x)):
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return repr(round(float(x), 9))
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if "datetime" in str(df[c].dtype):
            df = df.assign(**{c: df[c].dt.date})
    return sorted(tuple(map(_plain, r)) for r in df.astype(object).itertuples(index=False))
