"""Rows packed into blocks of numbers, one row of a table a block, for fits that go over all rows many times."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import DataFrame, SparkSession

from flowsieve.functions.values import col
from flowsieve.sources.workspace import dropped, scratch_path

SCHEMA = "block bigint, rows int, labels binary, numbers binary"
# A task of a pass reads files of about this size, a block at a time: Spark's reader would put thousands of rows, here blocks, into one array.
PASS_SETTINGS = {"spark.sql.files.maxPartitionBytes": 64 << 20, "spark.sql.parquet.columnarReaderBatchSize": 1, "spark.sql.execution.arrow.maxRecordsPerBatch": 1}
LABEL_TYPE = np.uint16


@dataclass(frozen=True)
class Scaling:
    """What a fitted scaler does to a row: the same operations, so that the numbers are the same."""

    mean: np.ndarray | None
    factor: np.ndarray | None

    @classmethod
    def of(cls, scaler: StandardScalerModel | None) -> Scaling:
        if scaler is None:
            return cls(None, None)
        std = scaler.std.toArray()
        factor = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0) if scaler.getWithStd() else None
        return cls(scaler.mean.toArray() if scaler.getWithMean() else None, factor)

    def apply(self, columns: np.ndarray) -> np.ndarray:
        """Columns as rows of a matrix, scaled."""
        if self.mean is not None:
            columns = columns - self.mean[:, None]
        return columns if self.factor is None else columns * self.factor[:, None]


def matrix(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    """A row of the matrix for each column; null and NaN are errors, as they are when vectors are assembled."""
    values = np.array([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in names], dtype=float)
    if np.isnan(values).any():
        raise ValueError("null or NaN in a feature: clean the rows first")
    return values


@contextmanager
def packed(rows: DataFrame, label_index: str, features: Sequence[str], encode: Callable[[np.ndarray], bytes], block_rows: int) -> Iterator[DataFrame]:
    """All rows as stored blocks, to be read in passes, deleted afterwards: (block, rows, labels, numbers).

    `encode` makes a block's bytes from a matrix with a row for each feature. A block's number does not change from pass to pass. The files
    are in the shared folder, so that every executor reads them.
    """
    spark, names = rows.sparkSession, [f"f{i}" for i in range(len(features))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, waiting = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, block_rows - waiting)
                held.append(part)
                start, waiting = start + part.num_rows, waiting + part.num_rows
                if waiting == block_rows:
                    yield block(number, held)
                    number, held, waiting = number + 1, [], 0
        if waiting:
            yield block(number, held)

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        labels = table.column("label").to_numpy().astype(LABEL_TYPE)
        values = [[number], [table.num_rows], [labels.tobytes()], [encode(matrix(table, names))]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "rows", "labels", "numbers"])

    numbers = rows.select(col(label_index).cast("double").alias("label"), *[col(c).cast("double").alias(n) for c, n in zip(features, names)])
    path = scratch_path(spark, "blocks")
    with dropped(spark, path):
        numbers.mapInArrow(pack, SCHEMA).write.option("compression", "none").parquet(path)
        yield passes(spark).read.schema(SCHEMA).parquet(path)


def passes(spark: SparkSession) -> SparkSession:
    """A session whose tasks read one block at a time."""
    own = spark.newSession()
    for name, value in PASS_SETTINGS.items():
        own.conf.set(name, str(value))
    return own
