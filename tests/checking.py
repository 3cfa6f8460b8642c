"""Run a registered query in Spark and its SQL twin in DuckDB and compare all rows."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_duckdb(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral() else float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_cell(row[i]) for i in order]) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty if both sides hold the same columns and rows."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(columns)}"]
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return []
    missing = [r for r in expected if r not in set(actual)][:3]
    extra = [r for r in actual if r not in set(expected)][:3]
    return [f"{len(actual)} rows against {len(expected)}", *[f"missing {m}" for m in missing], *[f"extra {e}" for e in extra]]
