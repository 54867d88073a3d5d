"""Run a registered query in Spark and its SQL in DuckDB and compare schema and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

FAMILIES = {
    "bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "string": "text", "boolean": "bool",
    "BIGINT": "int", "INTEGER": "int", "HUGEINT": "int", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "text", "BOOLEAN": "bool",
}


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_in_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, sql: str, con) -> list[str]:
    """What does not match, as short messages; empty if all rows and types agree."""
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    expected_types = {r[0]: FAMILIES.get(r[1].split("(")[0], r[1]) for r in described}
    actual_types = {n: FAMILIES.get(t.split("(")[0], t) for n, t in df.dtypes}
    found = []
    if expected_types != actual_types:
        found.append(f"types {sorted(actual_types.items())} instead of {sorted(expected_types.items())}")
    actual = rows_in_order(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql).fetchall()
    expected = rows_in_order([r[0] for r in described], result)
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows instead of {len(expected)}")
    unequal = [(a, e) for a, e in zip(actual, expected) if a != e]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return found
