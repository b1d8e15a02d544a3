"""Compare a registered query with its DuckDB form on the same parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    return v


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> tuple[int, list, list]:
    """Number of rows, and the rows that only Spark and only DuckDB has (columns sorted by name)."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = _sorted(df.select(*names).collect())
    cur = duck(sf_dir).execute(sql)
    have = [d[0] for d in cur.description]
    assert sorted(have) == names, (sorted(have), names)
    at = [have.index(n) for n in names]
    theirs = _sorted([tuple(r[i] for i in at) for r in cur.fetchall()])
    from collections import Counter

    a, b = Counter(map(repr, ours)), Counter(map(repr, theirs))
    return len(ours), list((a - b).elements())[:5], list((b - a).elements())[:5]
