"""Compares a query with its SQL on one of the test data folders."""

import glob
import os

import duckdb
import pandas as pd

DATA = os.environ.get("RATEWRIGHT_DATA", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    return con


def _cell(x):
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        return str([_cell(y) for y in (x.tolist() if hasattr(x, "tolist") else x)]) if not isinstance(x, (int, float, str)) and hasattr(x, "__len__") else _cell(x.item())
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def canonical(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, [tuple(map(_cell, r)) for r in df.itertuples(index=False)]))
