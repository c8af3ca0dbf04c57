"""A query's rows against those of its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(norm(r[k]) for k in order) for r in rows), key=repr)


def agrees(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    expected = rows_of([c[0] for c in got.description], got.fetchall())
    df = query(spark, sf_dir)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected
