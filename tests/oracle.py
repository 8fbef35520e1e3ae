"""Run a query and its SQL on the same tables and compare rows."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value: object) -> str:
    if value is None or value != value:
        return "NULL"
    return f"{value:.10g}" if isinstance(value, float) else str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def same_rows(df: DataFrame, sql: str, sf_dir: str) -> None:
    got = df.collect()
    result = duck(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert sorted((n, kinds[t]) for n, t in df.dtypes) == sorted((d[0], str(d[1])) for d in result.description)
    assert rows_of(df.columns, [tuple(r) for r in got]) == rows_of(names, result.fetchall())
