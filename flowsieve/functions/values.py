"""Predicates that keep null, NaN and infinity apart."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

INFINITY = float("inf")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name; names may hold spaces, dots and slashes."""
    return F.col(quoted(name))


def has_nan(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def missing(name: str, data_type: T.DataType) -> Column:
    """Null, or NaN where the type has it; `isnan` of a string would raise under ANSI casts."""
    is_null = col(name).isNull()
    return is_null | F.isnan(col(name)) if has_nan(data_type) else is_null


def not_nan(name: str, data_type: T.DataType) -> Column:
    """The value with NaN turned to null."""
    return F.when(~F.isnan(col(name)), col(name)) if has_nan(data_type) else col(name)


def finite(name: str) -> Column:
    """Neither null, NaN nor infinite, in one comparison: NaN sorts above infinity, and a null gives
    null, which `filter` and `when` treat as false. The optimizer pushes the null test to the scan."""
    return F.abs(col(name).cast("double")) < INFINITY


def differs(a: str, b: str) -> Column:
    """Null-safe inequality: two nulls, or two NaN, are equal."""
    return ~col(a).eqNullSafe(col(b))


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {field.name: field.dataType for field in df.schema.fields}


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]
