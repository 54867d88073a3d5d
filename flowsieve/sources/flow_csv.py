"""Raw CSV with a header line per file, read as text without inference."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, types as T
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.values import col
from flowsieve.operators.clean import is_data_row
from flowsieve.sources.ledger import PATH, plain_path

SOURCE_FILE, COLUMNS_BEFORE, COLUMNS_DROPPED = "source_file", "columns_before", "columns_dropped"
TRACE = (SOURCE_FILE, COLUMNS_BEFORE, COLUMNS_DROPPED)
LANE, RECORD = "lane", "malformed_record"
# The lanes of read rows, and what their numbers are called in reports.
LANES = {"header": "repeated_headers", "unlabelled": "unlabelled", "malformed": "malformed", "data": "rows_kept"}
# The header pass gives each file a task of its own, which stops at the header line.
HEADER_PASS = {"spark.sql.files.maxPartitionBytes": 1 << 36, "spark.sql.files.openCostInBytes": 1 << 36, "spark.sql.execution.arrow.maxRecordsPerBatch": 16}


def literal(path: str) -> str:
    """The path as a pattern that matches this name only, as readers take paths as patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def strings(spark: SparkSession, columns: Sequence[str]) -> DataFrameReader:
    """A reader of headered CSV with these columns, all as text."""
    return spark.read.option("header", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Files of one header, every column as string. With `columns` given, no file is opened for its names."""
    reader = spark.read.option("header", True).option("inferSchema", False) if columns is None else strings(spark, columns)
    return reader.csv([literal(p) for p in paths])


def header_lines(spark: SparkSession, folder: str | Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """(file_path, line): the header line of each of a folder's CSV files, or of the named ones; only their beginnings are read."""

    def first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, line in enumerate(batch.column("line").to_pylist()):
                if line.strip():
                    yield batch.slice(i, 1)
                    return

    own = spark.newSession()
    for name, value in HEADER_PASS.items():
        own.conf.set(name, str(value))
    files = own.read.option("pathGlobFilter", pattern).text(folder) if isinstance(folder, str) else own.read.text([literal(p) for p in folder])
    lines = files.select(F.col("value").alias("line"), "_metadata.file_path", "_metadata.file_block_start")
    return lines.filter("file_block_start = 0").select("file_path", "line").mapInArrow(first_line, "file_path string, line string")


def files_by_header(spark: SparkSession, folder: str | Sequence[str], pattern: str = "*.csv") -> dict[str, list[str]]:
    """Paths of a folder's CSV files, or of the named ones, by their header line: one job for any number of files."""
    groups: dict[str, list[str]] = defaultdict(list)
    for path, line in sorted(tuple(r) for r in header_lines(spark, folder, pattern).collect()):
        groups[line].append(unquote(path))  # the metadata give it as a URI
    return dict(sorted(groups.items()))


def read_csv_folder(
    spark: SparkSession, folder: str, drop: Iterable[str] = tuple(N.RAW_DROP), pattern: str = "*.csv", columns: Sequence[str] | None = None
) -> DataFrame:
    """All files of a folder as one table of strings, just as they are written, without the columns to drop.

    Files may differ in columns and in their order: those with the same header line are one scan, so there are
    as many scans as header lines, not files. With one header line the folder is read as it is; with several, the paths of each
    line's files are named to the reader, whose own index holds them too. With `columns` given, only these are read; one that a file lacks
    is null there. Each row carries its file name and the column counts of its file's header.
    """
    first = header_lines(spark, folder, pattern).groupBy("line").agg(F.min("file_path").alias("one")).collect()  # a row per header line
    if not first:
        raise FileNotFoundError(f"no header line in {pattern} of {folder}")
    if len(first) == 1:
        shapes = [(read_csv(spark, [unquote(first[0]["one"])]).columns, None)]
    else:
        shapes = [(read_csv(spark, paths[:1]).columns, paths) for paths in files_by_header(spark, folder, pattern).values()]
    unwanted = set(drop)
    kept = [c for c in (columns if columns is not None else sorted({c for header, _ in shapes for c in header})) if c not in unwanted]
    parts = [
        (read_csv(spark, paths, header) if paths else strings(spark, header).option("pathGlobFilter", pattern).csv(folder)).select(
            *[(col(c) if c in header else F.lit(None).cast("string")).alias(c) for c in kept],
            F.col("_metadata.file_name").alias(SOURCE_FILE),
            F.lit(len(header)).alias(COLUMNS_BEFORE),
            F.lit(len(unwanted & set(header))).alias(COLUMNS_DROPPED),
        )
        for header, paths in shapes
    ]
    return reduce(DataFrame.union, parts)


def read_csv_lanes(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], drop: Iterable[str] = tuple(N.RAW_DROP), label: str = N.LABEL) -> DataFrame:
    """The named files as strings, one scan per header line, every row with its lane, its file's path and its file's column counts.

    Lanes: `malformed` (a row with too few or too many fields, whose text is kept in `record`), `header` (the header line
    once more), `unlabelled` and `data`. Columns that a file lacks are null.
    """
    parts = []
    for header_paths in files_by_header(spark, paths).values():
        header = read_csv(spark, header_paths[:1]).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, RECORD]])
        reader = spark.read.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD, columnPruning=False)  # the number of fields is only known if all are read
        lane = (
            F.when(col(RECORD).isNotNull(), "malformed").when(col(label) == label, "header").when(col(label).isNull(), "unlabelled").otherwise("data")
            if label in header
            else F.when(col(RECORD).isNotNull(), "malformed").otherwise("unlabelled")
        )
        parts.append(
            reader.schema(schema).csv([literal(p) for p in header_paths]).select(
                *[(col(c) if c in header else F.lit(None).cast("string")).alias(c) for c in columns],
                plain_path(F.col("_metadata.file_path")).alias(PATH), lane.alias(LANE), col(RECORD),
                F.lit(len(header)).alias(COLUMNS_BEFORE), F.lit(len(set(drop) & set(header))).alias(COLUMNS_DROPPED),
            )
        )
    nothing = T.StructType([*(T.StructField(c, T.StringType()) for c in (*columns, PATH, LANE, RECORD)), *(T.StructField(c, T.IntegerType()) for c in (COLUMNS_BEFORE, COLUMNS_DROPPED))])
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], nothing)


def load_report(raw: DataFrame, label: str = N.LABEL) -> DataFrame:
    """Rows read and removed, columns read and dropped, per source file, in one aggregate."""
    removed = ~F.coalesce(is_data_row(label), F.lit(False))
    return raw.groupBy(*TRACE).agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(removed).alias("rows_removed"),
    )
