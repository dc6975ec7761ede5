"""Comparison of a Spark result with DuckDB's."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"create view {t} as select * from '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value != value:
        return ""
    if isinstance(value, (str, bool, list, np.bool_, np.ndarray)) or not hasattr(value, "__float__"):
        return str(value)
    return repr(round(float(value), 9))


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False, name=None))
