"""Comparison of a query with its SQL over the same tables."""

import glob
import os

import duckdb
import pandas as pd


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    def show(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(object).map(show).str.replace(r"\.0$", "", regex=True)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def database(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    a, b = tidy(got), tidy(expected)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    diff = a.merge(b, how="outer", indicator=True).query("_merge != 'both'")
    assert diff.empty, diff.head(5).to_string()
