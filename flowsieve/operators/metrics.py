"""Classification metrics from one pass over the scored rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.values import col
from flowsieve.operators.features import LABEL_INDEX


def confusion_counts(scored: DataFrame, label: str = LABEL_INDEX, prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction): at most classes squared, counted per task first."""
    return scored.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def metrics(confusion: DataFrame) -> DataFrame:
    """Accuracy and class-size-weighted precision, recall and F1 as one row.

    A class that is never predicted, or never hit, adds zero. The windows run over the confusion
    counts, not over rows.
    """
    actual = F.sum("n").over(Window.partitionBy("label"))
    predicted = F.sum("n").over(Window.partitionBy("prediction"))
    total = F.sum("n").over(Window.partitionBy())
    sized = confusion.select("label", "prediction", "n", actual.alias("actual"), predicted.alias("predicted"), total.alias("total"))
    weight = F.col("actual") / F.col("total")
    precision, recall = F.col("n") / F.col("predicted"), F.col("n") / F.col("actual")
    hit = F.col("label") == F.col("prediction")

    def weighted(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(hit, weight * value)), F.lit(0.0))

    return sized.agg(
        F.coalesce(F.sum(F.when(hit, F.col("n") / F.col("total"))), F.lit(0.0)).alias("accuracy"),
        weighted(precision).alias("weighted_precision"),
        weighted(recall).alias("weighted_recall"),
        weighted(2 * precision * recall / (precision + recall)).alias("f1"),
    )


def evaluate(scored: DataFrame, label: str = LABEL_INDEX, prediction: str = "prediction") -> DataFrame:
    return metrics(confusion_counts(scored, label, prediction))


@contextmanager
def cached_projection(df: DataFrame, columns: Sequence[str]) -> Iterator[DataFrame]:
    """A few columns kept while several results are taken from them, released afterwards."""
    kept = df.select(*[col(c) for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
