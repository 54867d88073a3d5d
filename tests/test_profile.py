from __future__ import annotations

import math

from pyspark.sql import functions as F

from flowsieve.operators import duplicates, profile

NAN = math.nan


def by_column(df, field):
    return {r["column"]: r[field] for r in df.collect()}


def test_missing_counts_text_and_numbers(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, None), (None, "b")], "x double, Label string")
    assert by_column(profile.missing_counts(df), "missing") == {"x": 2, "Label": 1}


def test_constant_columns(spark):
    rows = [(7.0, None, 7.0, 1.0), (7.0, None, NAN, 2.0), (7.0, None, None, 1.0)]
    df = spark.createDataFrame(rows, "d double, e double, f double, v double")
    assert by_column(profile.constant_columns(df), "is_constant") == {"d": True, "e": True, "f": True, "v": False}
    assert set(by_column(profile.constant_columns(df.limit(1)), "is_constant").values()) == {True}


def test_wide_and_long_forms_agree(spark):
    df = spark.range(500).select(*[((F.col("id") * (i + 3)) % (i + 2)).cast("double").alias(f"c {i}/x") for i in range(30)])
    values = {c: F.col(f"`{c}`") for c in df.columns}
    metrics = {"n": profile.Metric(F.count, 0), "low": profile.Metric(F.min), "high": profile.Metric(F.max)}
    wide = profile.column_profile(df, values, metrics, wide_aggregates=1000)
    long = profile.column_profile(df, values, metrics, wide_aggregates=0)
    assert sorted(wide.collect()) == sorted(long.collect())
    empty = profile.column_profile(df.filter("`c 0/x` < 0"), values, metrics, wide_aggregates=0)
    assert {(r["n"], r["low"]) for r in empty.collect()} == {(0, None)}


def test_duplicates_are_nominated_and_confirmed(spark):
    rows = [(float(i), float(i), float(9 - i), None if i == 3 else float(i), NAN if i == 5 else float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, reversed double, gap double, nan double")
    df = df.withColumn("nan too", F.col("nan")).withColumn("gap too", F.col("gap"))
    assert dict(duplicates.candidate_pairs(df)) == {"b": "a", "nan too": "nan", "gap too": "gap"}
    checked = duplicates.duplicate_verification(df, [("b", "a"), ("gap", "a"), ("reversed", "a"), ("nan too", "nan")])
    assert {(r["copy"], r["differences"], r["confirmed"]) for r in checked.collect()} == {
        ("b", 0, True), ("gap", 1, False), ("reversed", 10, False), ("nan too", 0, True),
    }
    assert duplicates.drop_duplicate_columns(df).columns == ["a", "reversed", "gap", "nan"]


def test_fingerprints_hold_when_every_row_is_repeated(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (2.0, 1.0), (2.0, 1.0)], "a double, b double")
    assert duplicates.candidate_pairs(df) == []


def test_no_pairs_to_verify(spark):
    df = spark.range(3)
    assert duplicates.duplicate_columns(df).count() == 0


def test_index_histogram_breaks_ties_by_label(spark):
    df = spark.createDataFrame([("z",), ("z",), ("c",), ("a",), ("b",), (None,)], "Label string")
    assert [r["Label"] for r in profile.index_histogram(df).collect()] == ["z", "a", "b", "c"]


def test_describe_handles_text(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "t string, v double")
    got = {r["column"]: r for r in profile.describe_columns(df).collect()}
    assert (got["t"]["mean"], got["t"]["min_text"], got["t"]["max_text"]) == (None, "x", "y")
    assert (got["v"]["mean"], got["v"]["min"], got["v"]["max"]) == (2.0, 1.0, 3.0)


def test_profiles_of_odd_names(spark):
    df = spark.createDataFrame([(1.0, 1.0, "x"), (NAN, NAN, None)], "`a.b` double, `c/s d` double, Label string")
    assert by_column(profile.missing_counts(df), "missing") == {"a.b": 1, "c/s d": 1, "Label": 1}
    assert duplicates.candidate_pairs(df) == [("c/s d", "a.b")]
    assert duplicates.drop_duplicate_columns(df).columns == ["a.b", "Label"]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_constants_of_all_types_take_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select id, 1.5D as d, if(id > 2, 'b', 'a') as s, date'2020-01-01' as t, cast(id as decimal(20,2)) as m from range(5)").write.parquet(path)
    found = profile.constant_columns(spark.read.parquet(path), exclude=[])
    assert scans(found) == 1
    assert by_column(found, "is_constant") == {"id": False, "d": True, "s": False, "t": True, "m": False}


def test_constants_of_many_columns_are_not_sorted(spark, tmp_path):
    """The cells of a wide table go through hash tables, text as well."""
    path = str(tmp_path / "t")
    spark.range(5).selectExpr("id", *[f"concat('v', id % {i % 3 + 1}) as s{i}" for i in range(30)]).write.parquet(path)
    found = profile.constant_columns(spark.read.parquet(path), exclude=[])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert by_column(found, "is_constant") == {"id": False, **{f"s{i}": i % 3 == 0 for i in range(30)}}


def test_types_need_no_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select id, 'x' as s from range(5)").write.parquet(path)
    assert scans(profile.type_check(spark.read.parquet(path))) == 0
