"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(spark_df.columns)
    assert columns == sorted(names)
    order = lambda row: tuple((x is not None, str(x)) for x in row)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in spark_df.collect()), key=order)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=order)
    assert len(got) == len(want)
    assert got == want
