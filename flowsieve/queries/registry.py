"""The query table and the formatting that both engines share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query, with the SQL that must give the same rows if there is one."""

    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column | str, digits: int = DIGITS) -> Column:
    """Rounded, with minus zero turned to zero."""
    return F.round(value, digits) + F.lit(0.0)


def round_columns(df: DataFrame, columns: Sequence[str], digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def sql_round(expression: str, digits: int = DIGITS) -> str:
    return f"round({expression}, {digits}) + 0.0"


def sql_name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def per_column_sql(source: str, columns: Sequence[str], metrics: dict[str, Callable[[str], str]], with_sql: str = "") -> str:
    """One row per column from one aggregate each, in column order."""
    branches = [
        f"SELECT {i} AS position, {sql_text(c)} AS \"column\", "
        + ", ".join(f"{make(c)} AS {name}" for name, make in metrics.items())
        + f" FROM {source}"
        for i, c in enumerate(columns)
    ]
    return with_sql + " UNION ALL ".join(branches)
