"""Compare a query with its SQL in DuckDB: names, rows, values."""

import datetime as dt
import decimal
import math
import os

import duckdb

import __spark_entry__ as entry


def plain(x):
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float | decimal.Decimal):
        return "nan" if math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, int):
        return float(x)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return bytes(x) if isinstance(x, bytearray) else str(x) if isinstance(x, dt.date | dt.time | dt.timedelta) else x


def rows_of(t):
    names = sorted(t.column_names)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in t.to_pylist()), key=repr)


def tables(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        path = f"{folder}/{f}" if os.path.isfile(f"{folder}/{f}") else f"{folder}/{f}/*.parquet"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(spark, con, folder, name):
    """None where the query and its SQL agree, else what differs first."""
    mine = rows_of(entry.queries()[name](spark, folder).toArrow())
    theirs = rows_of(con.sql(entry.oracle_sql()[name]).to_arrow_table())
    if mine[0] != theirs[0]:
        return f"names {mine[0]} {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return "; ".join(f"{c}: {x!r} {y!r}" for c, x, y in zip(mine[0], a, b) if x != y)[:600]
    return None
