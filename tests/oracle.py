"""Rows of a query and of its SQL, in one comparable form."""

import os

import duckdb

DATA = "/root/testdata"


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if v is not None else "\0"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def sql_rows(sf, sql):
    con = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{sf}/{f}'")
    r = con.sql(sql)
    return sorted(r.columns), rows_of(r.columns, r.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])
