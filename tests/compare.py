"""Rows of a Spark query against those of its SQL, order aside."""

import datetime
import decimal
import math
import os

import duckdb


def duck(folder: str):
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return c


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def check(spark, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    cursor = duck(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())
