"""Comparison of a Spark result with DuckDB's, without regard to order."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pandas as pd


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name[:-8]} as from '{sf}/{name}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        if isinstance(x, bool):
            return str(x)
        return round(float(x), 6) if isinstance(x, (int, float, decimal.Decimal)) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)
