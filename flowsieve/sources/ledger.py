"""Datasets that grow file by file: every file is taken in once, and readers see whole batches only.

A dataset has two folders. `data/<batch>` holds the rows of a batch, each with the path of its file. `ledger/<batch>` holds one
row per file of the batch: path, size, time of change, what was counted, and how many files the batch has. The ledger rows are
written last, in one file, after the written rows were counted again from the footers, so they are the commit:

- a batch whose ledger is missing or not whole is not read, whatever its data folder holds;
- a rerun takes only files that no whole batch has, by path, size and time;
- a file that has changed is taken again, and its rows of earlier batches are left out from then on;
- of rival batches with the same file, all readers take the same one, the first by name.

Nothing is ever replaced or deleted.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, types as T
from pyspark.sql import functions as F

from flowsieve.functions.tables import BROADCAST_ROWS
from flowsieve.functions.values import col

PATH = "source_path"
FILE = ["path", "size", "modified"]
FILE_SCHEMA = "path string, size bigint, modified bigint"
COUNTS = ["columns_before", "columns_dropped", "rows_before", "repeated_headers", "unlabelled", "malformed", "rows_kept"]
ENTRY = "batch string, files bigint, path string, size bigint, modified bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def plain_path(uri: Column) -> Column:
    """A file's path as listings have it, from the encoded URI of `_metadata.file_path`."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def listing(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """Path, size and time of change (in microseconds) of a folder's files that are not empty, without opening them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    return files.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def written(df: DataFrame, path: str) -> int:
    """Write the rows to a new place, counting them on the way; an error if the footers do not hold as many."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).count()
    if rows != seen.get["rows"]:
        raise RuntimeError(f"{path} holds {rows} rows instead of {seen.get['rows']}")
    return rows


@dataclass(frozen=True)
class Ledger:
    """The ledger of the dataset under `root`."""

    spark: SparkSession
    root: str

    def new_batch(self) -> str:
        """A name that no other batch has; names sort by time."""
        return f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def data_path(self, batch: str) -> str:
        return f"{self.root.rstrip('/')}/data/{batch}"

    def entries(self) -> DataFrame:
        """The files of all whole batches."""
        try:
            every = self.spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(f"{self.root.rstrip('/')}/ledger")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ENTRY)
        here = F.count(F.lit(1)).over(Window.partitionBy("batch"))
        return every.withColumn("here", here).filter("here = files").drop("here")

    def current(self) -> DataFrame:
        """One entry per path: the latest state of the file, of rival batches the first."""
        latest = Window.partitionBy("path").orderBy(F.desc("modified"), F.asc("batch"))
        return self.entries().withColumn("place", F.row_number().over(latest)).filter("place = 1").drop("place")

    def unread(self, files: DataFrame) -> DataFrame:
        """The listed files that no whole batch holds as they are now."""
        return files.join(self.entries().select(*FILE), FILE, "left_anti")

    def commit(self, batch: str, files: DataFrame, counts: DataFrame) -> DataFrame:
        """Put the batch's files into the ledger, with their counts by path; files without rows count none."""
        counted = files.join(counts, "path", "left").withColumn("batch", F.lit(batch)).withColumn("files", F.lit(files.count()))
        filled = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS]
        path = f"{self.root.rstrip('/')}/ledger/{batch}"
        counted.select("batch", "files", *FILE, *filled).coalesce(1).write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(ENTRY).parquet(path)

    def read(self, schema: T.StructType) -> DataFrame:
        """The rows of all current files, as the batches were written.

        Batches that are current as a whole are one plain scan; only in those with a superseded file are rows looked up by path.
        """
        current = self.current().select("batch", "path", "files")
        state = current.groupBy("batch").agg((F.count(F.lit(1)) == F.max("files")).alias("whole")).collect()  # a row per batch
        whole, mixed = ([self.data_path(r["batch"]) for r in state if r["whole"] is keep] for keep in (True, False))
        rows = self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)
        for path in mixed:
            batch = path.rsplit("/", 1)[1]
            valid = current.filter(F.col("batch") == batch).select(F.col("path").alias(PATH))
            valid = F.broadcast(valid) if valid.count() <= BROADCAST_ROWS else valid
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(path).join(valid, PATH, "left_semi").select(*[col(c) for c in schema.names]))
        return rows


# --- versions that replace each other


VERSION = "version bigint, name string, rows bigint"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The published versions: number, folder name, rows."""
    try:
        return spark.read.schema(VERSION).option("recursiveFileLookup", True).parquet(f"{root.rstrip('/')}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSION)


def current_version(spark: SparkSession, root: str) -> dict | None:
    """The last published version; of rivals with the same number, all readers take the first by name."""
    last = versions(spark, root).orderBy(F.desc("version"), "name").first()
    return last and last.asDict()


def publish(df: DataFrame, root: str) -> dict:
    """Write the rows as a new version of the dataset and publish it: the manifest that readers follow comes last.

    The rows may be read from the current version, which stays as it is. A write that fails leaves a folder no reader looks at.
    """
    spark = df.sparkSession
    last = current_version(spark, root)
    version, name = (last["version"] if last else 0) + 1, f"v{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows = written(df, f"{root.rstrip('/')}/data/{name}")
    manifest = spark.createDataFrame([(version, name, rows)], VERSION)
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{root.rstrip('/')}/manifest/{name}")
    return {"version": version, "name": name, "rows": rows}


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the current version."""
    last = current_version(spark, root)
    if last is None:
        raise FileNotFoundError(f"no published version in {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/data/{last['name']}")
