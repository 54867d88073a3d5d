"""Facts from footers: equal to those of a scan, pushed into the reader, and scanned where statistics are missing."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flowsieve.operators import profile
from flowsieve.sources import footers


@pytest.fixture
def path(spark, tmp_path):
    df = spark.range(0, 5000, 1, 4).selectExpr(
        "id", "cast(7 as int) as same", "if(id % 3 = 0, null, cast(id % 50 as short)) as `gaps a.b`", "id > 9 as flag", "date_add(date '2020-01-01', cast(id % 9 as int)) as day",
        "cast(null as int) as nothing", "if(id % 2 = 0, double('NaN'), 1.5D) as x", "id * 0.5D as y", "concat('t', id % 2) as s", "'one' as t", "cast(1.25 as decimal(9, 2)) as d",
    )
    df.write.parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")


def test_rows_and_ranges_are_pushed_to_the_reader(spark, path):
    plan = footers.pushed_aggregate(spark, path, ["id", "same", "gaps a.b"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(id), MIN(id), MAX(id)" in plan
    assert footers.stored_rows(spark, path) == 5000
    found = {r["column"]: (r["present"], r["low"], r["high"]) for r in footers.stored_ranges(spark, path).collect()}
    assert found == {
        "id": (5000, "0", "4999"), "same": (5000, "7", "7"), "gaps a.b": (3333, "0", "49"), "flag": (5000, "false", "true"),
        "day": (5000, "2020-01-01", "2020-01-09"), "nothing": (0, None, None),
    }
    assert "nothing" not in footers.from_footers(spark, path, footers.exact_columns(spark.read.parquet(path)))  # no file has its least value
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown", "false") == "false"


def test_constants_as_by_a_scan(spark, path):
    df = spark.read.parquet(path)
    facts = lambda found: sorted((r["column"], r["present"], r["is_constant"]) for r in found.collect())
    assert facts(footers.stored_constants(spark, path)) == facts(profile.constant_columns(df))
    assert {c for c, _, constant in facts(profile.constant_columns(df)) if constant} == {"same", "nothing", "x", "t", "d"}


def test_files_without_statistics_are_scanned(spark, tmp_path):
    pq.write_table(pa.table({"a": pa.array([3, None, 5], pa.int64())}), str(tmp_path / "p.parquet"), write_statistics=False)
    assert tuple(footers.stored_ranges(spark, str(tmp_path / "p.parquet")).first()) == (0, "a", 2, "3", "5")
    assert footers.stored_rows(spark, str(tmp_path / "p.parquet")) == 3
