"""Facts of stored Parquet tables that their footers hold: rows, present values, least and greatest values, without reading a column.

Aggregates are pushed into the reader of a session of its own with the settings for it, so no setting of the caller's session changes.
Only columns of whole numbers, dates and truth values are answered so: for these the statistics are exact. Floating-point columns may hide
NaN, and text may be cut short in statistics, so they are scanned.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.tables import local_table
from flowsieve.functions.values import col, field_types
from flowsieve.operators import profile

PUSHED = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}
EXACT_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def pushed_aggregate(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the table, and the present, least and greatest values of the columns, as one aggregate over footers."""
    own = spark.newSession()
    for name, value in PUSHED.items():
        own.conf.set(name, value)
    facts = [make(col(c)).alias(f"{kind}{i}") for i, c in enumerate(columns) for kind, make in (("present", F.count), ("low", F.min), ("high", F.max))]
    return own.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *facts)


def stored_rows(spark: SparkSession, path: str) -> int:
    """Rows of a stored table."""
    return pushed_aggregate(spark, path, []).first()["rows"]


def exact_columns(df: DataFrame) -> list[str]:
    """Columns that footers answer exactly."""
    return [c for c, kind in field_types(df).items() if isinstance(kind, EXACT_TYPES)]


def from_footers(spark: SparkSession, path: str, columns: Sequence[str]) -> dict[str, tuple]:
    """(present, low, high) of the columns whose statistics all files have; a column without is found by halving, by footers alone."""
    try:
        row = pushed_aggregate(spark, path, columns).first()
        return {c: tuple(row[3 * i + 1 : 3 * i + 4]) for i, c in enumerate(columns)}
    except (PySparkException, Py4JJavaError) as missing:
        if "aggregatePushdown" not in str(missing):
            raise
    half = len(columns) // 2
    return from_footers(spark, path, columns[:half]) | from_footers(spark, path, columns[half:]) if half else {}


def stored_ranges(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, column, present, low, high), the values as text, of the columns that footers answer exactly.

    Columns without statistics in some file (all null there, say) are scanned, all in one aggregate.
    """
    df = spark.read.parquet(path)
    chosen = [c for c in exact_columns(df) if columns is None or c in set(columns)]
    found = from_footers(spark, path, chosen) if chosen else {}
    if rest := [c for c in chosen if c not in found]:
        row = df.agg(*[make(col(c)) for c in rest for make in (F.count, F.min, F.max)]).first()
        found |= {c: tuple(row[3 * i : 3 * i + 3]) for i, c in enumerate(rest)}
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    rows = [(i, c, found[c][0], text(found[c][1]), text(found[c][2])) for i, c in enumerate(chosen)]
    return local_table(spark, rows, {"position": "int", "column": "string", "present": "bigint", "low": "string", "high": "string"})


def stored_constants(spark: SparkSession, path: str, exclude: Sequence[str] = (N.LABEL,)) -> DataFrame:
    """(column, present, is_constant) as `profile.constant_columns`; only columns that footers do not answer are scanned."""
    df = spark.read.parquet(path).drop(*exclude)
    answered = stored_ranges(spark, path, df.columns).select("column", "present", F.col("low").eqNullSafe(F.col("high")).alias("is_constant"))
    rest = df.drop(*exact_columns(df))
    return answered.unionByName(profile.constant_columns(rest, ())) if rest.columns else answered
