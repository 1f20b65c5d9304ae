"""Compare a Spark result with DuckDB's over the same tables."""

import math
from pathlib import Path

import duckdb


def connection(sf: str):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "is_integer") or hasattr(v, "as_tuple") else str(v)


def rows(columns: list, values) -> list:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in values), key=repr)


def same(df, sql: str, sf: str) -> None:
    theirs = connection(sf).sql(sql)
    assert sorted(df.columns) == sorted(theirs.columns)
    mine, other = rows(df.columns, df.collect()), rows(theirs.columns, theirs.fetchall())
    assert len(mine) == len(other), (len(mine), len(other))
    differing = [(a, b) for a, b in zip(mine, other, strict=True) if a != b]
    assert not differing, (len(differing), differing[:3])
