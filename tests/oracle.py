"""Compares a query with its SQL as multisets of rows; floats to six places."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return c


def rows(values, columns):
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, list) else v
    return sorted((tuple(map(plain, r)) for r in values), key=repr), columns


def same(spark, sf_dir, query, sql) -> None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = rows(df.select(*[f"`{c}`" for c in columns]).collect(), columns)
    r = views(sf_dir).sql(sql)
    assert sorted(r.columns) == columns
    assert got == rows(r.select(*[f'"{c}"' for c in columns]).fetchall(), columns)
