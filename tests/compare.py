"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        return (1, repr(v))
    return (1, str(v))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty if names, row count, types and values agree exactly."""
    rel = con.sql(sql)
    names, kinds = rel.columns, [str(t) for t in rel.types]
    want, got = rel.fetchall(), [tuple(r) for r in df.collect()]
    out = []
    names = list(names)
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: {sorted(set(names) ^ set(df.columns))}"]
    spark_kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    for name, kind in df.dtypes:
        duck_kind = kinds[names.index(name)]
        if spark_kinds[kind] != duck_kind:
            out.append(f"type of {name}: {kind} vs {duck_kind}")
    if len(want) != len(got):
        out.append(f"rows: {len(got)} vs {len(want)}")
    a, b = _rows(df.columns, got), _rows(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        cols = sorted(names)
        diff = [(c, p, w) for c, p, w in zip(cols, x, y) if p != w][:4]
        out.append(f"{len(bad)} rows differ, first: {diff}")
    return out
