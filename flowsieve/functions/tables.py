"""Small tables of fitted facts (class moments, quantile brackets) used as join sides, and the settings that wide tables and fits need."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
# The JVM compiles no method of more bytecode than this and interprets it instead, some ten times slower.
COMPILED_METHOD = "8000"
ARROW_TYPES = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: dict[str, str]) -> DataFrame:
    """Driver-side rows as a local relation, whose size the optimizer knows."""
    values = list(zip(*rows)) if rows else [()] * len(schema)
    fields = [pa.field(name, ARROW_TYPES[kind]) for name, kind in schema.items()]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields)], schema=pa.schema(fields)))


def fact_table(spark: SparkSession, rows: Sequence[tuple], schema: dict[str, str]) -> DataFrame:
    """The rows as a join side, marked for broadcast only while their counted number is small.

    Beyond the bound no hint is given and the join goes by shuffle.
    """
    table = local_table(spark, rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def compile_wide(spark: SparkSession) -> None:
    """Let stages over many columns run in split methods, which the JVM compiles, instead of one method too long for it.

    It sets `spark.sql.codegen.hugeMethodLimit` of the session, as Spark advises for this JVM; results are the same.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD)


@contextmanager
def read_splits(spark: SparkSession, most: int) -> Iterator[None]:
    """Files are read in splits of at most `most` bytes meanwhile, a file of about that size alone.

    For jobs that keep each partition in a larger form than the files have, such as fits: Spark would put files of
    narrow rows together up to 128 MB, whose rows as vectors are gigabytes in one block.
    """
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def release_shuffles(spark: SparkSession, every: float = 30.0) -> Iterator[None]:
    """Shuffle files that no step needs any more, earlier ones too, are deleted meanwhile, every so many seconds.

    Spark deletes the files of a shuffle when the driver's JVM collects what names it, which a driver with little to do
    puts off: a fit, which shuffles once a level, would leave all of them on the executors' disks.
    """
    jvm, done = spark.sparkContext._jvm, threading.Event()

    def ask() -> None:
        while not done.wait(every):
            jvm.System.gc()

    asking = threading.Thread(target=ask, daemon=True)
    asking.start()
    try:
        yield
    finally:
        done.set()
        asking.join()
