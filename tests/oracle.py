"""Runs a query and its DuckDB form and compares their rows."""

import glob
import math
import os


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return value


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def assert_same(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(normal(row[c]) for c in columns)) for row in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(normal(row[i]) for i in places)) for row in result.fetchall())
