"""The files that queries build grow in number with the rows, not in size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowsieve.queries import ingestion, learning
from flowsieve.sources import flow_csv, ledger

ROWS = 600


@pytest.fixture()
def lines(spark, tmp_path):
    """A folder with some line items; its name is new, as built files are kept by it."""
    folder = str(tmp_path)
    spark.range(ROWS).selectExpr(
        "id as l_orderkey", "id % 50 as l_partkey", "id % 20 as l_suppkey", "cast(id % 7 + 1 as int) as l_linenumber", "cast(id % 50 + 1 as double) as l_quantity",
        "cast(900 + id as double) as l_extendedprice", "cast(id % 10 as double) / 100 as l_discount", "cast(id % 9 as double) / 100 as l_tax", "array('R', 'A', 'N')[id % 3] as l_returnflag",
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def lines_per_file(spark, folder, pattern):
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    return [r["count"] for r in files.groupBy(F.col("_metadata.file_path")).count().collect()]


def test_raw_files_hold_a_bounded_number_of_rows(spark, lines, monkeypatch):
    monkeypatch.setitem(ingestion.RAW_WRITING, "maxRecordsPerFile", 20)
    held = lines_per_file(spark, ingestion.raw_folder(spark, lines), ingestion.RAW_PATTERN)
    assert max(held) <= 21 and sum(held) == ROWS + len(held)
    report = flow_csv.load_report(ingestion.raw_rows(spark, lines))
    assert report.agg(F.sum("rows_before")).first()[0] == ROWS


def test_large_file_numbers_have_parts(spark, lines, monkeypatch):
    monkeypatch.setattr(ingestion, "PART_ROWS", 20)
    root, _ = ingestion.grown_dataset(spark, lines)
    entries = ledger.Ledger(spark, root).current().collect()
    assert len(entries) == 5 * ingestion.FILES and all(0 < e["rows_before"] < 60 for e in entries)
    report = ingestion.csv_load_report_files(spark, lines).collect()
    assert sorted(r["file"] for r in report) == list(range(ingestion.FILES))
    assert all(r["rows_before"] == ROWS / ingestion.FILES and r["columns_before"] == len(ingestion.FILE_COLUMNS) + r["file"] % 2 for r in report)


def test_training_table_has_more_partitions_for_more_rows(spark, lines, monkeypatch):
    monkeypatch.setattr(learning, "DECIDED_ROWS", 20)
    held = learning.decided(spark, lines).groupBy(F.col("_metadata.file_path")).count().collect()
    assert len(held) > 16 and sum(r["count"] for r in held) == ROWS
