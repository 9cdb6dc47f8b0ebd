"""Runs registered queries beside their SQL and compares rows."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, float):
        return round(v, 9)
    return v


def difference(df, sql: str, c) -> str:
    """Empty if both give the same rows under the same column names."""
    rel = c.sql(sql)
    names = sorted(rel.columns)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    mine = sorted((tuple(_cell(v) for v in r) for r in df.select(*names).collect()), key=repr)
    theirs = sorted((tuple(_cell(v) for v in r) for r in rel.select(*[f'"{n}"' for n in names]).fetchall()), key=repr)
    if mine == theirs:
        return ""
    odd = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:2]
    return f"{len(mine)} and {len(theirs)} rows; {odd}"
