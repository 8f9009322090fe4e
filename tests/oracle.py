"""Spark results against DuckDB's on the same files."""

import math
from pathlib import Path

import duckdb

TYPES = {"long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{where}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, float):
        return f"{x + 0.0:.9g}"
    if hasattr(x, "isoformat"):
        return x.isoformat().replace("T00:00:00", "")
    return str(x)


def differences(df, con, sql):
    """What tells a DataFrame from an SQL result, as text; empty if nothing does."""
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    got_types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    if got_types != want_types:
        return f"types: {sorted(set(got_types.items()) ^ set(want_types.items()))}"
    names = sorted(got_types)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = {c: i for i, c in enumerate(rel.columns)}
    want = sorted(tuple(plain(r[at[c]]) for c in names) for r in rel.fetchall())
    if got != want:
        only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"rows {len(got)} {len(want)}; {names}; Spark only {only[0]}; SQL only {only[1]}"
    return ""
