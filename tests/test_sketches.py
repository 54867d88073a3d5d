"""Stored sketches: errors against exact answers, merging, odd values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(3000, 2.0), rng.lognormal(0, 2, 20_000), [math.nan, math.inf, -math.inf]])
    frame = pd.DataFrame({"x": x, "c": [None if i % 5 == 0 else f"c{i % 2}" for i in range(len(x))], "file": [i % 7 for i in range(len(x))]})
    return frame, spark.createDataFrame(frame).repartition(6)


def test_ranks_are_within_the_error(rows):
    frame, df = rows
    shares = [0.0, 0.001, 0.1, 0.5, 0.9, 0.999, 1.0]
    found = sketches.sketched_quantiles(sketches.quantile_sketches(df, "c", ["x", "absent"], by="file"), shares).collect()
    assert len(found) == 3 * len(shares)
    for r in found:
        own = frame.x[(frame.c.isna() if r["class"] is None else frame.c == r["class"]) & np.isfinite(frame.x)]
        assert r["n"] == len(own)
        assert (own < r["value"]).mean() <= r["share"] + sketches.rank_error() and (own <= r["value"]).mean() >= r["share"] - sketches.rank_error()


def test_boxes_without_rows(rows):
    frame, df = rows
    for r in sketches.sketched_boxes(sketches.quantile_sketches(df, "c", ["x"], by="file")).collect():
        own = frame.x[(frame.c.isna() if r["class"] is None else frame.c == r["class"]) & np.isfinite(frame.x)]
        assert own.min() <= r["fence_low"] <= r["q1"] <= r["median"] <= r["q3"] <= r["fence_high"] <= own.max()
        outside = ((own < r["fence_low"]) | (own > r["fence_high"])).sum()
        assert abs(outside - r["outliers"]) <= (2 * sketches.rank_error() + 2 / sketches.GRID) * len(own)


def test_a_smaller_sketch_says_so():
    assert sketches.rank_error(200) > 4 * sketches.rank_error(1000)


def test_frequent_labels_are_exact(spark):
    labels = spark.range(50_000).select(F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 20 == 1, "b").when(F.col("id") % 1000 == 7, None).otherwise(F.concat(F.lit("x"), "id")).alias("Label"), (F.col("id") % 3).alias("file"))
    stored = sketches.label_sketches(labels, by="file")
    assert [tuple(r) for r in sketches.frequent_labels(labels, stored, 0.02).select("label", "n").collect()] == [("a", 5000), ("b", 2500)]
    n, distinct = sketches.distinct_labels(stored).first()
    exact = labels.select("Label").dropna().distinct().count()
    assert n == 49_950 and abs(distinct - exact) <= sketches.distinct_error() * exact
    with pytest.raises(ValueError, match="track 8000"):
        sketches.frequent_labels(labels, stored, 0.001)


def test_no_rows(spark):
    none = spark.createDataFrame([], "Label string, c string, x double")
    assert sketches.sketched_boxes(sketches.quantile_sketches(none, "c", ["x"])).count() == 0
    assert tuple(sketches.distinct_labels(sketches.label_sketches(none)).first()) == (0, 0)
    assert sketches.frequent_labels(none, sketches.label_sketches(none), 0.1).count() == 0
