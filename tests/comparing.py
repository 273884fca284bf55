"""Running a query beside its DuckDB text."""

import glob
import math
import os
from decimal import Decimal

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def both(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    return rows_of(df.columns, df.collect()), rows_of(want.columns, want.fetchall())
