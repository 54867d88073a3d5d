from __future__ import annotations

import math

import pytest

from flowsieve.functions import names as N
from flowsieve.operators import clean

NAN, INF = math.nan, math.inf


@pytest.fixture
def values(spark):
    rows = [(1, 1.0, "Benign"), (2, NAN, "Benign"), (3, None, "Bot"), (4, INF, "Bot"), (5, -INF, None)]
    return spark.createDataFrame(rows, "id int, x double, Label string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_repeated_headers_and_null_labels_go(spark):
    df = spark.createDataFrame([("Label",), ("Benign",), (None,)], "Label string")
    assert [r["Label"] for r in clean.drop_repeated_headers(df).collect()] == ["Benign"]


def test_cast_reads_numbers_and_gives_null_for_text(spark):
    texts = ["1.5", "", "abc", "NaN", "Infinity", "-Infinity", " 2 ", "1e3", None]
    df = spark.createDataFrame([(t, "x") for t in texts], "`Flow Byts/s` string, Label string")
    got = [r[0] for r in clean.cast_features(df).collect()]
    assert got[:3] == [1.5, None, None] and math.isnan(got[3]) and got[4:] == [INF, -INF, 2.0, 1000.0, None]


def test_keep_present_keeps_infinities(values):
    assert ids(clean.keep_present(values, "x")) == [1, 4, 5]


def test_drop_nonfinite_is_idempotent(values):
    once = clean.drop_nonfinite_rows(values)
    assert ids(once) == [1] and ids(clean.drop_nonfinite_rows(once)) == [1]


def test_fill_missing_leaves_infinity(values):
    got = {r["id"]: r["x"] for r in clean.fill_missing(values).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: INF, 5: -INF}


def test_fill_nonfinite_zeroes_all(values):
    got = {r["id"]: r["x"] for r in clean.fill_nonfinite(values).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_binary_label_counts_null_as_rest(values):
    got = {r["id"]: r[N.BINARY_COLUMN] for r in clean.binary_label(values).collect()}
    assert got == {1: "Benigno", 2: "Benigno", 3: "Ataque", 4: "Ataque", 5: "Ataque"}


def test_feature_counts(spark):
    columns = ", ".join(f"`{c}` double" for c in N.FEATURES) + ", Label string"
    df = spark.createDataFrame([], columns)
    assert len(clean.feature_names(df)) == 66
    assert len(clean.feature_names(df, [*N.NOT_FEATURES, *N.REDUNDANT])) == 41
    assert len(clean.drop_if_present(df, N.KNOWN_COPIES).columns) == 63
    with pytest.raises(ValueError, match="Subflow Fwd Pkts"):
        clean.require_features(clean.drop_if_present(df, N.KNOWN_COPIES), N.FEATURES)


def test_names_with_dots_slashes_and_backticks(spark):
    names = ["a.b", "c/s d", "e`f"]
    schema = ", ".join(f"`{n.replace('`', '``')}` double" for n in names) + ", Label string"
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "x"), (NAN, 1.0, 1.0, "y"), (1.0, INF, 1.0, "z"), (1.0, 1.0, None, "w")], schema)
    assert [r["Label"] for r in clean.drop_nonfinite_rows(df).collect()] == ["x"]
    assert [tuple(r)[:3] for r in clean.fill_missing(df).collect()][1:] == [(0.0, 1.0, 1.0), (1.0, INF, 1.0), (1.0, 1.0, 0.0)]
    assert [tuple(r)[:3] for r in clean.fill_nonfinite(df).collect()][2] == (1.0, 0.0, 1.0)
    assert clean.feature_names(clean.cast_features(df)) == names
    assert clean.keep_present(df, "a.b").count() == 3


def test_null_tests_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select cast(id as double) as a, if(id > 2, null, 1.0D) as b from range(5)").write.parquet(path)
    found = clean.drop_nonfinite_rows(spark.read.parquet(path))
    assert found.count() == 3
    pushed = found._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(a)" in pushed and "IsNotNull(b)" in pushed
