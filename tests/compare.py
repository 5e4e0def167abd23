"""Holds a query's rows against its SQL on the same Parquet tables, in any order."""

from __future__ import annotations

import math
import os

import duckdb

DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _kind(t) -> str:
    s = str(t)
    return {"large_string": "string"}.get(s, "timestamp" if s.startswith("timestamp") else s)


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if names, types and rows agree."""
    got = df.toArrow()
    want = connection(sf_dir).sql(sql).to_arrow_table()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return f"columns {names} and {sorted(want.column_names)}"
    kinds = [(n, _kind(got.schema.field(n).type), _kind(want.schema.field(n).type)) for n in names]
    if odd := [k for k in kinds if k[1] != k[2]]:
        return f"types {odd}"
    rows = lambda t: sorted((tuple(_cell(v) for v in r) for r in zip(*(t.column(n).to_pylist() for n in names), strict=True)), key=repr)
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; only here {[x for x in a if x not in b][:2]}, only there {[x for x in b if x not in a][:2]}"
    for x, y in zip(a, b, strict=True):
        if x != y and not all(u == v or isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=2e-6) for u, v in zip(x, y, strict=True)):
            return f"{dict(zip(names, x, strict=True))} and {dict(zip(names, y, strict=True))}"
    return "" if a else "no rows"
