"""Rows of a DataFrame and of DuckDB SQL in one form."""

import math
from decimal import Decimal

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 8)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted(([plain(r[k]) for k in order] for r in found.fetchall()), key=str)
