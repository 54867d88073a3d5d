"""Repeatable ingest, rows apart that are no data, and published versions."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.plans import ingest
from flowsieve.sources import flow_csv, ledger

COLUMNS = ["x", "y", N.LABEL]
REPORT = ["columns_before", "columns_dropped", "rows_before", "repeated_headers", "unlabelled", "malformed", "rows_kept"]


def put(folder, name, lines, seconds=None):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    if seconds:
        os.utime(path, (seconds, seconds))


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "raw files"
    made.mkdir()
    put(made, "a.csv", ["x,y,Protocol,Label", "1,2,6,Benign", "x,y,Protocol,Label", "3,abc,6,Bot", "7", "1,2,6,Bot,extra,fields", "4,5,6,"])
    put(made, "b+[1] c%20.csv", ["Label,Protocol,Src IP,x", "Bot,6,1.1.1.1,9", "Benign,6,1.1.1.1,NaN"])
    put(made, "empty.csv", ["Label,x"])
    (made / "nothing.csv").write_text("")
    (made / "notes.txt").write_text("no data\n")
    return made


def report(df):
    return {os.path.basename(r["path"]): tuple(r[c] for c in REPORT) for r in df.collect()}


def rows(spark, root):
    return sorted(repr(tuple(r)) for r in ingest.ingested(spark, root, columns=COLUMNS).collect())


def written_as(*expected):
    return sorted(map(repr, expected))  # NaN is equal to nothing, but is written alike


FIRST = {"a.csv": (4, 1, 6, 1, 1, 2, 2), "b+[1] c%20.csv": (4, 2, 2, 0, 0, 0, 2), "empty.csv": (0, 0, 0, 0, 0, 0, 0)}  # a file of no bytes is no file
FIRST_ROWS = [(1.0, 2.0, "Benign"), (3.0, None, "Bot"), (9.0, None, "Bot"), (float("nan"), None, "Benign")]


def test_each_file_is_taken_in_once(spark, folder, tmp_path):
    root = str(tmp_path / "flows")
    assert report(ingest.ingest_new(spark, str(folder), root, columns=COLUMNS)) == FIRST
    assert rows(spark, root) == written_as(*FIRST_ROWS)
    assert ingest.ingest_new(spark, str(folder), root, columns=COLUMNS).count() == 0
    put(folder, "d.csv", ["y,x,Label", "1,2,New"])
    assert report(ingest.ingest_new(spark, str(folder), root, columns=COLUMNS)) == {"d.csv": (3, 0, 1, 0, 0, 0, 1)}
    assert rows(spark, root) == written_as(*FIRST_ROWS, (2.0, 1.0, "New"))
    assert report(ledger.Ledger(spark, root).current()) == FIRST | {"d.csv": (3, 0, 1, 0, 0, 0, 1)}


def test_malformed_rows_keep_their_text(spark, folder, tmp_path):
    root = str(tmp_path / "flows")
    ingest.ingest_new(spark, str(folder), root, columns=COLUMNS)
    kept = ingest.rejected(spark, root, columns=COLUMNS).select("lane", "malformed_record").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([("header", None), ("unlabelled", None), ("malformed", "7"), ("malformed", "1,2,6,Bot,extra,fields")], key=repr)


def test_a_changed_file_replaces_its_rows(spark, folder, tmp_path):
    root = str(tmp_path / "flows")
    ingest.ingest_new(spark, str(folder), root, columns=COLUMNS)
    put(folder, "a.csv", ["x,Label", "100,Bot"], seconds=4_000_000_000)
    assert report(ingest.ingest_new(spark, str(folder), root, columns=COLUMNS)) == {"a.csv": (2, 0, 1, 0, 0, 0, 1)}
    assert rows(spark, root) == written_as(*FIRST_ROWS[2:], (100.0, None, "Bot"))
    assert ingest.ingest_new(spark, str(folder), root, columns=COLUMNS).count() == 0


def test_what_is_not_whole_is_not_read(spark, folder, tmp_path):
    """A batch without ledger, one whose ledger lacks a file, and a rival of the good one."""
    root = str(tmp_path / "flows")
    ingest.ingest_new(spark, str(folder), root, columns=COLUMNS)
    book = ledger.Ledger(spark, root)
    good = book.entries()
    data = spark.read.parquet(book.data_path(good.first()["batch"]))
    data.write.parquet(book.data_path("0-crashed"))
    data.write.parquet(book.data_path("0-half"))
    good.filter("path like '%/a.csv'").withColumn("batch", F.lit("0-half")).write.parquet(f"{root}/ledger/0-half")
    data.write.parquet(book.data_path("~rival"))
    good.withColumn("batch", F.lit("~rival")).write.parquet(f"{root}/ledger/~rival")
    assert rows(spark, root) == written_as(*FIRST_ROWS)
    assert ingest.ingest_new(spark, str(folder), root, columns=COLUMNS).count() == 0


def test_the_files_are_parsed_once(spark, folder, tmp_path):
    """One scan per header line when the rows are written; the report is read from the ledger alone."""
    paths = [r["path"] for r in ledger.listing(spark, str(folder)).collect()]
    raw = flow_csv.read_csv_lanes(spark, paths, COLUMNS)
    assert raw._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == len(flow_csv.files_by_header(spark, paths)) == 3
    found = ingest.ingest_new(spark, str(folder), str(tmp_path / "flows"), columns=COLUMNS)
    assert found.inputFiles() and all("/ledger/" in path for path in found.inputFiles())


def test_rows_lost_while_writing_are_an_error(spark, tmp_path, monkeypatch):
    class Wrong:
        get = {"rows": 7}

    monkeypatch.setattr(ledger, "Observation", Wrong)
    rows = spark.range(3)
    monkeypatch.setattr(type(rows), "observe", lambda df, *_: df)
    with pytest.raises(RuntimeError, match="3 rows instead of 7"):
        ledger.publish(rows, str(tmp_path / "d"))
    assert ledger.current_version(spark, str(tmp_path / "d")) is None


def test_versions(spark, tmp_path):
    root = str(tmp_path / "flows")
    with pytest.raises(FileNotFoundError):
        ledger.read_current(spark, root)
    assert ledger.publish(spark.range(5), root)["version"] == 1
    with pytest.raises(Exception, match="boom"):
        ledger.publish(spark.range(9).selectExpr("if(id > 7, raise_error('boom'), id) as id"), root)
    assert ledger.read_current(spark, root).count() == 5
    second = ledger.publish(ledger.read_current(spark, root).filter("id > 1"), root)
    assert (second["version"], second["rows"]) == (2, 3)
    rival = f"{root}/data/~late"
    spark.range(100).write.parquet(rival)
    spark.createDataFrame([(2, "~late", 100)], ledger.VERSION).write.parquet(f"{root}/manifest/~late")
    assert sorted(r["id"] for r in ledger.read_current(spark, root).collect()) == [2, 3, 4]
