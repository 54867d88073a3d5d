"""Pairwise correlation on all rows, in long form, and the redundancy decided from it.

A value that is null or NaN leaves its row out of the pairs of that column only. A pair has no
correlation (null) when a column is constant, or infinite somewhere, on the rows of the pair, or when
its squares overflow. Every task reduces its rows to the moments of each pair, shifted by values of
its own rows; moments are merged by the exact formula for means, central squares and co-moments.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.values import col

MOMENTS = ["n", "mean_a", "mean_b", "square_a", "square_b", "product", "infinite"]


CANCELLED = 1e-6


def batch_moments(x: np.ndarray, upper_a: np.ndarray, upper_b: np.ndarray) -> np.ndarray:
    """Rows, means, central squares, co-moment and infinities of every pair of columns, over the pair's own rows.

    Matrix products of values shifted by each column's mean give all pairs at once. Where the rows of a pair lie
    so far from that mean that squares cancel, the pair is worked out by itself in two passes.
    """
    infinite = np.isinf(x)
    usable = ~np.isnan(x) & ~infinite
    counts = usable.sum(axis=0)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        first = np.where(counts > 0, x[usable.argmax(axis=0), np.arange(x.shape[1])], 0.0)
        shift = first + np.where(usable, x - first, 0.0).sum(axis=0) / np.maximum(counts, 1)
        constant = np.where(usable, x, -np.inf).max(axis=0) == np.where(usable, x, np.inf).min(axis=0)
        shift = np.where(constant, first, shift)  # a constant column leaves exactly nothing
        y, present = np.where(usable, x - shift, 0.0), usable.astype(float)
        sums, squares, products = y.T @ present, (y * y).T @ present, (y.T @ y)[upper_a, upper_b]
        spoiled = infinite.astype(float).T @ (present + infinite) + present.T @ infinite.astype(float)
        n = (present.T @ present)[upper_a, upper_b]
        some = np.maximum(n, 1.0)
        sum_a, sum_b, raw_a, raw_b = sums[upper_a, upper_b], sums[upper_b, upper_a], squares[upper_a, upper_b], squares[upper_b, upper_a]
        square_a, square_b = raw_a - sum_a * sum_a / some, raw_b - sum_b * sum_b / some
        moments = np.array([n, shift[upper_a] + sum_a / some, shift[upper_b] + sum_b / some, square_a, square_b, products - sum_a * sum_b / some, spoiled[upper_a, upper_b]])
        for k in np.flatnonzero((n > 0) & ((raw_a > 0) & (square_a <= CANCELLED * raw_a) | (raw_b > 0) & (square_b <= CANCELLED * raw_b))):
            rows = usable[:, upper_a[k]] & usable[:, upper_b[k]]
            moments[1:6, k] = pair_in_two_passes(x[rows, upper_a[k]], x[rows, upper_b[k]])
    return moments


def pair_in_two_passes(a: np.ndarray, b: np.ndarray) -> tuple[float, ...]:
    """Means, central squares and co-moment; a column with one value has a square of exactly zero."""
    mean_a, mean_b = (v[0] if v.min() == v.max() else v[0] + (v - v[0]).mean() for v in (a, b))
    return mean_a, mean_b, ((a - mean_a) ** 2).sum(), ((b - mean_b) ** 2).sum(), ((a - mean_a) * (b - mean_b)).sum()


def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The moments of both sets of rows."""
    n = one[0] + two[0]
    with np.errstate(over="ignore", invalid="ignore"):
        share = np.where(n > 0, two[0] / np.maximum(n, 1.0), 0.0)
        d_a, d_b, weight = np.where(two[0] > 0, two[1] - one[1], 0.0), np.where(two[0] > 0, two[2] - one[2], 0.0), one[0] * share
        empty = one[0] == 0
        mean_a, mean_b = np.where(empty, two[1], one[1] + d_a * share), np.where(empty, two[2], one[2] + d_b * share)
        extra = lambda x, y: np.where(weight > 0, x * y * weight, 0.0)
        return np.array([n, mean_a, mean_b, one[3] + two[3] + extra(d_a, d_a), one[4] + two[4] + extra(d_b, d_b), one[5] + two[5] + extra(d_a, d_b), one[6] + two[6]])


def packed(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"moments": pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())})


def task_moments(width: int):
    """The moments of all pairs over one task's rows, batch by batch, as one row."""
    upper_a, upper_b = np.triu_indices(width, k=1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(MOMENTS), len(upper_a)))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
                total = merged(total, batch_moments(x, upper_a, upper_b))
        yield packed(total)

    return task


def merged_rows(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
    """One row after the other: memory for two of them."""
    total = None
    for batch in batches:
        for row in batch.column("moments"):
            moments = np.frombuffer(row.as_buffer(), dtype=float).reshape(len(MOMENTS), -1)
            total = moments if total is None else merged(total, moments)
    return total


def merge_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = merged_rows(batches)
    if total is not None:
        yield packed(total)


def coefficients(columns: Sequence[str]):
    """The last merge, and a row for each pair."""
    upper_a, upper_b = np.triu_indices(len(columns), k=1)
    names = pa.array(list(columns), pa.string())

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, _, _, square_a, square_b, product, infinite = merged_rows(batches)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            raw = product / (np.sqrt(square_a) * np.sqrt(square_b))
        usable = (n > 0) & (infinite == 0) & (square_a > 0) & (square_b > 0) & np.isfinite(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper_a, pa.int32()), pa.array(upper_b, pa.int32()), names.take(pa.array(upper_a)), names.take(pa.array(upper_b)), pa.array(np.clip(raw, -1.0, 1.0), mask=~usable)],
            names=["position_a", "position_b", "column_a", "column_b", "r"],
        )

    return last


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position_a, position_b, column_a, column_b, r) for every pair of columns a before b.

    One scan; a task sends one row with the moments of all pairs (56 bytes a pair). These rows are merged by the tasks of one shuffle and
    then in one task, each holding two rows at a time; so what is shuffled grows with the tasks and not with tasks and pairs as rows.
    A table without rows gives every pair without a value.
    """
    doubles = df.select([col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    nothing = df.sparkSession.range(1, numPartitions=1).select(*[F.lit(None).cast("double").alias(f"c{i}") for i in range(len(columns))])
    task = task_moments(len(columns))
    partial = doubles.mapInArrow(task, "moments binary").union(nothing.mapInArrow(task, "moments binary"))
    merged_once = partial.withColumn("task", F.spark_partition_id()).repartition("task").select("moments").mapInArrow(merge_some, "moments binary")
    return merged_once.repartition(1).mapInArrow(coefficients(columns), "position_a int, position_b int, column_a string, column_b string, r double")


def high_correlation(pairs: DataFrame, threshold: float = N.HIGH_CORRELATION) -> DataFrame:
    """All pairs with |r| above the threshold, strongest first."""
    return pairs.filter(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "position_a", "position_b")


def redundant_columns(pairs: DataFrame, threshold: float = N.HIGH_CORRELATION) -> list[str]:
    """Columns to leave out, in column order: each one highly correlated with an earlier kept column.

    The decision runs on column names: at most one pair per two columns reaches the driver.
    """
    rows = high_correlation(pairs, threshold).select("position_a", "position_b", "column_b").collect()
    dropped: dict[int, str] = {}
    for row in sorted(rows, key=lambda row: (row["position_b"], row["position_a"])):
        if row["position_a"] not in dropped:
            dropped[row["position_b"]] = row["column_b"]
    return [dropped[p] for p in sorted(dropped)]
