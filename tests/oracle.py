"""Compares a query with its DuckDB oracle."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect())


def oracle_rows(con, sql):
    cursor = con.execute(f"SELECT * FROM ({sql})")
    names = sorted(d[0] for d in cursor.description)
    listed = ", ".join(f'"{n}"' for n in names)
    return names, sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT {listed} FROM ({sql})").fetchall())
