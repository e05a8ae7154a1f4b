"""Compare a query with its DuckDB counterpart: names, types, rows."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def differences(df, d: str, sql: str) -> list[str]:
    r = connect(d).execute(sql)
    names, types = [c[0] for c in r.description], [str(c[1]) for c in r.description]
    theirs = r.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    out = []
    mine = dict(df.dtypes)
    for n, t in zip(names, types, strict=True):
        if KINDS.get(mine[n], mine[n]) != t:
            out.append(f"type of {n}: {mine[n]} against {t}")
    order = sorted(names)
    at = [names.index(n) for n in order]
    a = Counter(tuple(plain(row[n]) for n in order) for row in df.collect())
    b = Counter(tuple(plain(row[i]) for i in at) for row in theirs)
    if a != b:
        out.append(f"{sum(a.values())} rows against {sum(b.values())}; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}")
    return out
