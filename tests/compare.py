"""A query's rows against those of its SQL in another engine, as order-free multisets."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        table, kind = os.path.splitext(name)
        if kind == ".parquet":
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return db


def plain(value):
    if value is None or value != value:
        return "null"
    return repr(float(value)) if isinstance(value, (int, float)) else str(value)


def multiset(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def check(spark, db, sf_dir, query, sql):
    df = query(spark, sf_dir)
    found = multiset(df.columns, df.collect())
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert found == multiset(names, cursor.fetchall())
