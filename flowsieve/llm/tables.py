"""Stored intermediate tables and text columns, shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.values import col
from flowsieve.sources.workspace import scratch_path

HOT_PARTS = 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back.

    It cuts lineage, and what is read from it stays the same when an executor is lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with a beginning that no column of the table has, so that what is added for a while cannot clash."""
    room, taken = "_", tuple(c.lower() for c in df.columns)
    while any(c.startswith(room) for c in taken):
        room += "_"
    return [room + name.lower() for name in names]


def id_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash."""
    return docs.select(col(id_column).alias("doc_id"), col(text_column).cast("string").alias("text"))


def id_type(docs: DataFrame, id_column: str = "doc_id") -> str:
    return docs.schema[id_column].dataType.simpleString()


def filled(texts: pa.Array) -> pa.Array:
    """The texts as one plain string array; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that copies made along the way stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ascii_lower(texts: pa.Array) -> pa.Array:
    """A-Z turned to a-z; every other code point stays."""
    return pc.ascii_lower(texts)


def raw_values(texts: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each value, without copies; `texts` comes from `filled`."""
    _, offsets, data = texts.buffers()
    starts = memoryview(offsets).cast("q")[texts.offset : texts.offset + len(texts) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    for i in range(len(texts)):
        yield view[starts[i] : starts[i + 1]]


def sha256_values(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v).digest() for v in raw_values(texts)], pa.binary())


def join_large_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of many rows with their group's facts, one row per key in `groups`.

    A key with more than a thousandth of all rows is joined by broadcast: there are fewer than a
    thousand such keys, whatever the data. All others go by shuffle. `groups` should be a stored table.
    """
    large = F.broadcast(groups.filter(F.col(size) * HOT_PARTS > F.lit(total)))
    hot = rows.join(large, key)
    rest = rows.join(large.select(key), key, "left_anti").join(groups.filter(F.col(size) * HOT_PARTS <= F.lit(total)), key)
    return hot.unionByName(rest)


def unsigned_mod(value: Column, parts: int) -> Column:
    return F.pmod(value, F.lit(parts).cast("bigint"))
