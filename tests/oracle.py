"""Comparing a query's rows with its SQL's."""

import math
import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def sql_rows(c, sql):
    rel = c.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(plain(r[k]) for k in order) for r in rel.fetchall())
