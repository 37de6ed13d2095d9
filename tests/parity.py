"""Spark and DuckDB side by side: the same columns and the same rows in any order."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def differences(df, con, sql: str) -> list[str]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    kinds = {d[0]: str(d[1]) for d in got.description}
    theirs = rows_of(names, got.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    for name, kind in df.dtypes:
        if not kinds[name].upper().startswith(KINDS.get(kind, kind).upper()):
            out.append(f"type of {name}: {kind} and {kinds[name]}")
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} and {len(theirs)}")
    a, b = set(ours), set(theirs)
    if a != b:
        out.append(f"only Spark {sorted(a - b, key=str)[:2]}, only DuckDB {sorted(b - a, key=str)[:2]}")
    return out
