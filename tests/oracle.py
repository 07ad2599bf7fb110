"""Row-for-row comparison of a query with its SQL twin in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def same(spark_df, con, sql: str) -> None:
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = con.sql(sql)
    want = rows(found.columns, found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    differ = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not differ, differ[:3]
