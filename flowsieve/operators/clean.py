"""Row and column cleaning with explicit rules for null, NaN and infinity."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.values import col, finite, numeric_columns, quoted


def is_data_row(label: str = N.LABEL) -> Column:
    """False for a header line repeated inside a file, null for a row without label."""
    return col(label) != label


def drop_repeated_headers(df: DataFrame, label: str = N.LABEL) -> DataFrame:
    """Keep data rows. Rows with a null label go too, as the comparison is null for them."""
    return df.filter(is_data_row(label))


def drop_if_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the columns the table has; other names are ignored."""
    return df.drop(*columns)


def cast_features(df: DataFrame, label: str = N.LABEL, keep: Sequence[str] = ()) -> DataFrame:
    """Every column but the label (and `keep`) as double; text that is no number becomes null."""
    untouched = {label, *keep}
    return df.select([col(c) if c in untouched else col(c).try_cast("double").alias(c) for c in df.columns])


def keep_present(df: DataFrame, column: str) -> DataFrame:
    """Keep rows where the column is neither null nor NaN."""
    return df.filter(is_present(column))


def is_finite_row(df: DataFrame, exclude: Iterable[str] = tuple(N.NOT_FEATURES)) -> Column:
    """False or null for a row with a null, NaN or infinite value in any numeric column not excluded."""
    columns = numeric_columns(df, exclude)
    if not columns:
        return F.lit(True)
    return reduce(Column.__and__, [finite(c) for c in columns])


def is_present(column: str) -> Column:
    """False for a null or NaN value of the column."""
    return col(column).isNotNull() & ~F.isnan(col(column))


def row_report(df: DataFrame, kept: dict[str, Column]) -> DataFrame:
    """(step, rows_before, rows_removed, rows_kept) of row filters given by name and condition, in one aggregate."""
    counts = [
        F.struct(
            F.lit(step).alias("step"), F.count(F.lit(1)).alias("rows_before"),
            (F.count(F.lit(1)) - F.count_if(condition)).alias("rows_removed"), F.count_if(condition).alias("rows_kept"),
        )
        for step, condition in kept.items()
    ]
    return df.agg(F.array(*counts).alias("steps")).select(F.inline("steps"))


def drop_nonfinite_rows(df: DataFrame, exclude: Iterable[str] = tuple(N.NOT_FEATURES)) -> DataFrame:
    """Remove rows with a null, NaN or infinite value in any numeric column not excluded.

    One comparison per column; the optimizer derives the null tests from them, and these reach the scan.
    """
    return df.filter(is_finite_row(df, exclude))


def fill_missing(df: DataFrame, label: str = N.LABEL) -> DataFrame:
    """Zero for null and NaN in numeric columns; infinities stay."""
    return df.fillna(0, subset=[quoted(c) for c in numeric_columns(df, [label])])


def numerics_to_double(df: DataFrame) -> DataFrame:
    """All numeric columns as double, in one projection."""
    numeric = set(numeric_columns(df))
    return df.select([col(c).cast("double").alias(c) if c in numeric else col(c) for c in df.columns])


def fill_nonfinite(df: DataFrame, label: str = N.LABEL, keep: Iterable[str] = ()) -> DataFrame:
    """Numeric columns as double with zero for null, NaN and infinities; the label and `keep` stay as they are."""
    numeric = set(numeric_columns(df, [label, *keep]))

    def filled(c: str) -> Column:
        return F.when(finite(c), col(c)).otherwise(F.lit(0)).cast("double").alias(c)

    return df.select([filled(c) if c in numeric else col(c) for c in df.columns])


def label_to_string(df: DataFrame, label: str = N.LABEL) -> DataFrame:
    return df.withColumn(label, col(label).cast("string"))


def feature_names(df: DataFrame, exclude: Iterable[str] = tuple(N.NOT_FEATURES)) -> list[str]:
    """Features by rule: every numeric column that is not excluded."""
    return numeric_columns(df, exclude)


def require_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The named features, or an error that lists those the table lacks."""
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"features not in the table: {absent}")
    return list(features)


def select_features(df: DataFrame, exclude: Iterable[str] = tuple(N.NOT_FEATURES), label: str | None = None) -> DataFrame:
    """The features by rule, with the label in front if one is named."""
    chosen = ([label] if label else []) + feature_names(df, exclude)
    return df.select([col(c) for c in chosen])


def binary_label(df: DataFrame, label: str = N.LABEL, majority: str = N.MAJORITY, into: str = N.BINARY_COLUMN) -> DataFrame:
    """Add the two-valued class: the majority class against all other rows."""
    return df.withColumn(into, F.when(col(label) == majority, N.BINARY_MAJORITY).otherwise(N.BINARY_REST))
