from __future__ import annotations

import math

import pytest

from flowsieve.functions import names as N
from flowsieve.plans import ingest
from flowsieve.sources import flow_csv, parquet, workspace


@pytest.fixture
def folder(tmp_path):
    base = [*N.FEATURES, "Timestamp", "Protocol"]
    rate = N.FEATURES.index(N.RATE_COLUMN)

    def line(value, label, extra=()):
        fields = [str(i) for i in range(len(N.FEATURES))] + ["t", "6"]
        fields[rate] = value
        return ",".join([*extra, *fields, label])

    header_a = ",".join([*base, "Label"])
    header_b = ",".join([*N.RAW_OPTIONAL, *base, "Label"])
    extra = ("f", "1.1.1.1", "2.2.2.2", "80")
    (tmp_path / "a.csv").write_text("\n".join([header_a, line("1.5", "Benign"), header_a, line("Infinity", "Bot"), line("abc", "Bot")]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([header_b, line("NaN", "Benign", extra), line("2.5", "", extra), line("", "Bot", extra)]) + "\n")
    (tmp_path / "notes.txt").write_text("not data\n")
    return str(tmp_path)


def test_report_per_file(spark, folder):
    raw = flow_csv.read_csv_folder(spark, folder)
    got = {r["source_file"]: tuple(r)[1:] for r in flow_csv.load_report(raw).collect()}
    assert got == {"a.csv": (69, 2, 4, 1), "b.csv": (73, 6, 3, 1)}


def test_header_shapes_clean_to_one_schema(spark, folder):
    cleaned = ingest.clean_raw(flow_csv.read_csv_folder(spark, folder))
    assert sorted(cleaned.columns) == sorted([*N.FEATURES, N.LABEL])
    assert {t for c, t in cleaned.dtypes if c != N.LABEL} == {"double"}
    rates = [r[0] for r in cleaned.select(f"`{N.RATE_COLUMN}`").collect()]
    assert len(rates) == 5
    assert sorted(str(x) for x in rates) == sorted(["1.5", "inf", "None", "nan", "None"])
    last = cleaned.select(f"`{N.FEATURES[-1]}`").distinct().collect()
    assert [r[0] for r in last] == [65.0]


def test_ingest_repair_and_balance(spark, folder, tmp_path):
    root = str(tmp_path / "flows")
    path, report = ingest.ingest(spark, folder, root, "v1")
    assert report.count() == 2 and parquet.written_rows(spark, path).first()["rows"] == 5
    repaired = ingest.repair(spark, path, root, "v2")
    rows = parquet.read_parquet(spark, repaired)
    assert rows.count() == 2 and all(not math.isnan(r[0]) for r in rows.select(f"`{N.RATE_COLUMN}`").collect())
    out = ingest.balanced(spark, path, str(tmp_path / "training"))
    balanced = parquet.read_parquet(spark, out)
    assert balanced.count() == 5 and not set(N.KNOWN_COPIES) & set(balanced.columns)


def test_version_is_never_replaced(spark, tmp_path):
    first = parquet.write_version(spark.range(3), str(tmp_path), "v1")
    with pytest.raises(Exception, match="already exists"):
        parquet.write_version(spark.range(5), str(tmp_path), "v1")
    assert parquet.written_rows(spark, first).first()["rows"] == 3


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "d")
    parquet.append_parquet(spark.range(3), path)
    parquet.append_parquet(spark.range(3), path)
    assert spark.read.parquet(path).count() == 6
    parquet.overwrite_parquet(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2


def test_small_tables_are_spread_and_empty_folders_refused(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(path)
    assert parquet.read_spread(spark, path).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        flow_csv.read_csv_folder(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("files", [2, 30])
def test_jobs_do_not_grow_with_the_files(spark, tmp_path, files):
    for i in range(files):
        (tmp_path / f"{i}.csv").write_text("a,Label\n1,x\n" if i % 2 else "Label,b,a\nx,2,1\n")
    tracker = spark.sparkContext.statusTracker()
    group = f"csv-{files}"
    spark.sparkContext.setJobGroup(group, "count jobs")
    rows = flow_csv.read_csv_folder(spark, str(tmp_path)).collect()
    spark.sparkContext.setJobGroup("other", "other")
    assert len(rows) == files and {(r["a"], r["Label"]) for r in rows} == {("1", "x")}
    assert len(tracker.getJobIdsForGroup(group)) <= 6


def test_odd_fields_keep_their_value(spark, tmp_path):
    """Number-like text may lose its zeros, as the docstring says; its value and all other text stay."""
    (tmp_path / "a.csv").write_text('x,it\'s a.b/c,Label\n007,1,Bot\n1e400," 8 ","a,b"\n,-Infinity,true\n1.5\n')
    raw = flow_csv.read_csv_folder(spark, str(tmp_path))
    rows = ingest.clean_raw(raw).select("x", "`it's a.b/c`", "Label").collect()
    assert [tuple(r) for r in rows] == [(7.0, 1.0, "Bot"), (math.inf, 8.0, "a,b"), (None, -math.inf, "true")]
    assert raw.filter("x = '1.5' and Label is null").count() == 1


def test_fields_are_read_as_they_are_written(spark, tmp_path):
    """No type is guessed, whatever the session zone; files of any name and header keep every character."""
    odd = ["007", "1.10", "1e3", "TRUE", "true", "2018-02-14T08:31:00Z", "2018-02-14", "2018-02-14 08:31:00", "1.0", "010", "01", "1", "12345678901234567890123", "-0", " 8 "]
    (tmp_path / "a [1].csv").write_text("x,Label\n" + "".join(f"{v},{v}\n" for v in odd))
    (tmp_path / "b%20c.csv").write_text("\nLabel,\"y,z\",x\n" + "".join(f"{v},,{v}\n" for v in odd))
    (tmp_path / "empty.csv").write_text("")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        raw = flow_csv.read_csv_folder(spark, str(tmp_path))
        assert sorted(raw.columns) == sorted(["x", "Label", "y,z", *flow_csv.TRACE])
        assert sorted(tuple(r) for r in raw.select("x", "Label").collect()) == sorted((v, v) for v in odd * 2)
        report = {r["source_file"]: tuple(r)[1:] for r in flow_csv.load_report(raw).collect()}
        assert sorted(report.values()) == [(2, 0, len(odd), 0), (3, 0, len(odd), 0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_scratch_of_this_application_is_cleared(spark, tmp_path, monkeypatch):
    """Only its own tables go; other applications' stay."""
    shared = workspace.shared_folder
    monkeypatch.setattr(workspace, "shared_folder", lambda spark, _: shared(spark, str(tmp_path)))
    spark.range(3).write.parquet(workspace.scratch_path(spark, "mine"))
    other = tmp_path / "flowsieve" / "app-of-another"
    other.mkdir()
    assert workspace.clear_scratch(spark) and [p.name for p in (tmp_path / "flowsieve").iterdir()] == ["app-of-another"]
    assert not workspace.clear_scratch(spark)
