"""Holds a Spark result against DuckDB's for the same tables."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def database(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) if v == v else "nan"
    return v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    found = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in found.description}
    rows = found.fetchall()
    assert sorted(theirs) == names
    place = [list(theirs).index(n) for n in names]
    got = in_order([tuple(map(plain, r)) for r in df.select(*(f"`{n}`" for n in names)).collect()])
    assert got == in_order([tuple(plain(r[i]) for i in place) for r in rows])
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema} == theirs
