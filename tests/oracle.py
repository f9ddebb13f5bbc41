"""Spark query against its DuckDB twin, on the given tables."""

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (Decimal, float)):
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, fn, sql):
    """None if both agree, else what differs."""
    df = fn(spark, sf_dir)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    b = rows_of([d[0] for d in got.description], got.fetchall())
    if a == b:
        return None
    only = [x for x in a[1] if x not in set(b[1])][:3], [x for x in b[1] if x not in set(a[1])][:3]
    return f"columns {a[0]} / {b[0]}, rows {len(a[1])} / {len(b[1])}, only Spark {only[0]}, only SQL {only[1]}"
