"""Compare a query with its SQL on the same tables."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, list):
        return repr([_plain(x) for x in v])
    return repr(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())
