"""Whole-table profiles. Per-column results come from one scan, in long form."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.tables import compile_wide, local_table
from flowsieve.functions.values import col, field_types, missing, not_nan


CARRY = "__carried"

# Up to this many aggregates one wide expression list is faster than a row for each cell; more go in long form.
WIDE_AGGREGATES = 200


@dataclass(frozen=True)
class Metric:
    """An aggregate over a column's values, and what an empty table gives."""

    of: Callable[[Column], Column]
    empty: Any = None


def column_profile(
    df: DataFrame,
    values: dict[str, Column],
    metrics: dict[str, Metric],
    carry: Column | None = None,
    wide_aggregates: int = WIDE_AGGREGATES,
) -> DataFrame:
    """(position, column, metrics...): the same aggregates for each of the named values, in one scan.

    The values must share one type. Up to `wide_aggregates` become one wide aggregate in split methods. More are exploded
    and aggregated by position, which stays in small compiled code; every task sends at most one row
    per column. `carry` mixes a per-row number into each value, as fingerprints need.
    """
    mixed = (lambda v: v) if carry is None else (lambda v: F.xxhash64(v, F.col(CARRY)))
    source = df if carry is None else df.withColumn(CARRY, carry)
    if len(values) * len(metrics) <= wide_aggregates:
        compile_wide(df.sparkSession)
        per_column = [
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), *[m.of(mixed(v)).alias(k) for k, m in metrics.items()])
            for i, (c, v) in enumerate(values.items())
        ]
        return source.agg(F.array(*per_column).alias("profile")).select(F.inline("profile"))
    carried = [] if carry is None else [F.col(CARRY)]
    exploded = source.select(*carried, F.posexplode(F.array(*values.values())).alias("position", "value"))
    found = exploded.groupBy("position").agg(*[m.of(mixed(F.col("value"))).alias(k) for k, m in metrics.items()])
    columns = local_table(df.sparkSession, list(enumerate(values)), {"position": "int", "column": "string"})
    result = columns.join(F.broadcast(found), "position", "left")
    filled = [F.col(k) if m.empty is None else F.coalesce(F.col(k), F.lit(m.empty)).alias(k) for k, m in metrics.items()]
    return result.select("position", "column", *filled)


def columnwise(df: DataFrame, columns: Sequence[str], metrics: dict[str, list[Column]]) -> DataFrame:
    """One aggregate over the table, then one output row per column.

    For a few columns of differing types: `metrics` maps an output name to one aggregate per column.
    """
    per_column = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            *[values[i].alias(name) for name, values in metrics.items()],
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(F.array(*per_column).alias("profile")).select(F.inline("profile"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def dimensions(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def class_counts(df: DataFrame, label: str = N.LABEL) -> DataFrame:
    """Rows per class; counted per task first, so a hot class moves one row per task."""
    return df.groupBy(col(label).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str = N.LABEL) -> DataFrame:
    return class_counts(df, label).orderBy(F.desc("n"), F.asc(label))


def class_share(df: DataFrame, label: str = N.LABEL) -> DataFrame:
    """Class counts with their percentage of all rows; the window runs over one row per class."""
    total = F.sum("n").over(Window.partitionBy())
    counts = class_counts(df, label).withColumn("share", F.col("n") * F.lit(100.0) / total)
    return counts.orderBy(F.desc("n"), F.asc(label))


def class_count(df: DataFrame, label: str = N.LABEL) -> DataFrame:
    """Number of distinct labels; null is one of them, as in a plain distinct."""
    return df.select(col(label)).distinct().agg(F.count(F.lit(1)).alias("classes"))


def index_histogram(df: DataFrame, label: str = N.LABEL) -> DataFrame:
    """Label index by falling frequency, ties by label, with the rows of each class."""
    by_frequency = Window.orderBy(F.desc("n"), F.asc(label))
    counts = class_counts(df.filter(col(label).isNotNull()), label)
    indexed = counts.withColumn("label_index", (F.row_number().over(by_frequency) - 1).cast("double"))
    return indexed.select("label_index", label, "n").orderBy("label_index")


def missing_counts(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Null or NaN values per column; text columns are tested for null only."""
    types = field_types(df)
    tests = {c: missing(c, types[c]) for c in df.columns if c not in set(exclude)}
    return column_profile(df, tests, {"missing": Metric(F.count_if, 0)})


# Types whose values a double holds exactly.
DOUBLE_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)


def constant_columns(df: DataFrame, exclude: Sequence[str] = (N.LABEL,)) -> DataFrame:
    """Columns with at most one value on all rows, null and NaN left out, in one scan.

    Numbers that a double holds exactly are compared as such, other types by two hashes of 64 bits. All lanes are numbers of
    fixed width, which are aggregated in hash tables, without a sort of the cells.
    """
    types = field_types(df)
    nothing = [F.lit(None).cast(kind) for kind in ("double", "bigint", "bigint")]
    values = {}
    for c in df.columns:
        if c not in set(exclude):
            if isinstance(types[c], DOUBLE_TYPES):
                lanes = [not_nan(c, types[c]).cast("double"), *nothing[1:]]
            else:
                lanes = [nothing[0], *(F.when(col(c).isNotNull(), F.xxhash64(F.lit(seed), col(c))) for seed in (1, 2))]
            values[c] = F.struct(*[v.alias(name) for v, name in zip(lanes, ("number", "hash", "other"))])
    metrics = {"present": Metric(lambda v: F.count_if(v["number"].isNotNull() | v["hash"].isNotNull()), 0)}
    for lane in ("number", "hash", "other"):
        metrics |= {f"low_{lane}": Metric(lambda v, lane=lane: F.min(v[lane])), f"high_{lane}": Metric(lambda v, lane=lane: F.max(v[lane]))}
    same = reduce(Column.__and__, [F.col(f"low_{lane}").eqNullSafe(F.col(f"high_{lane}")) for lane in ("number", "hash", "other")])
    return column_profile(df, values, metrics).select("column", "present", same.alias("is_constant"))


def type_check(df: DataFrame, label: str = N.LABEL) -> DataFrame:
    """Type of each column and whether it is text that should be numeric, from the schema alone."""
    types = field_types(df)
    rows = [(i, c, types[c].simpleString(), int(isinstance(types[c], T.StringType) and c != label)) for i, c in enumerate(df.columns)]
    schema = local_table(df.sparkSession, rows, {"position": "int", "column": "string", "type": "string", "text": "int"})
    return schema.select("position", "column", "type", (F.col("text") == 1).alias("should_be_numeric"))


def describe_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation and range of some columns (the first five by default).

    Text columns have no mean and no deviation; their range is in `min_text` and `max_text`.
    """
    types = field_types(df)
    chosen = list(columns) if columns is not None else df.columns[:5]
    numeric = {c: isinstance(types[c], T.NumericType) for c in chosen}
    number = [col(c).cast("double") if numeric[c] else F.lit(None).cast("double") for c in chosen]
    text = [F.lit(None).cast("string") if numeric[c] else col(c).cast("string") for c in chosen]
    return columnwise(
        df,
        chosen,
        {
            "present": [F.count(col(c)) for c in chosen],
            "mean": [F.avg(x) for x in number],
            "stddev": [F.stddev(x) for x in number],
            "min": [F.min(x) for x in number],
            "max": [F.max(x) for x in number],
            "min_text": [F.min(x) for x in text],
            "max_text": [F.max(x) for x in text],
        },
    )


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows per partition: their number is the partition count, their spread shows skew."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))
