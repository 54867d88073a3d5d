from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import correlation, distribution

NAN = math.nan


@pytest.fixture(scope="module")
def gaps():
    rng = np.random.default_rng(7)
    a = rng.normal(1e6, 1.0, 400)
    frame = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(0, 1, 400), "c": rng.normal(0, 1, 400), "flat": 5.0})
    frame.loc[rng.choice(400, 60, False), "a"] = NAN
    frame.loc[rng.choice(400, 60, False), "c"] = NAN
    return frame


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_correlation_skips_gaps_pairwise(spark, gaps, parts):
    expected = gaps.corr()
    got = correlation.correlation(spark.createDataFrame(gaps).repartition(parts), list(gaps.columns)).collect()
    assert len(got) == 6
    for row in got:
        want = expected.loc[row["column_a"], row["column_b"]]
        if "flat" in (row["column_a"], row["column_b"]):
            assert row["r"] is None
        else:
            assert row["r"] == pytest.approx(want, abs=1e-9)


def test_infinity_spoils_only_its_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 3.0, 1.0), (math.inf, 5.0, 4.0), (4.0, 1.0, None)], "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in correlation.correlation(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["a", "c"] is None and got["b", "c"] is not None


@pytest.mark.parametrize("parts", [1, 3, 16])
@pytest.mark.parametrize("width", [2, 12])
def test_correlation_does_not_depend_on_the_first_rows_or_the_width(spark, parts, width):
    rows = spark.range(0, 20_000, 1, 1).selectExpr(
        "if(id < 1000, null, 1e9D + id % 7) as a", "if(id < 1000, -1e9D, 1e9D + id % 7) as b", "if(id < 1000, 1e8D, id % 7 / 7D) as c", "if(id < 1000, null, id % 7 / 7D) as d",
        "1e200D * (id % 5) as e", "cast(7 as double) as f", *[f"cast(id % {k} as double) as x{k}" for k in range(3, 9)],
    ).repartition(parts)
    for pair, want in ((["a", "b"], 1.0), (["c", "d"], 1.0), (["e", "a"], None), (["f", "a"], None)):
        others = [f"x{k}" for k in range(3, 9)] if width > 2 else []
        got = correlation.correlation(rows, [*pair, *others]).filter("position_a = 0 and position_b = 1").first()["r"]
        assert got is None if want is None else got == pytest.approx(want, abs=1e-9)


def test_redundancy_keeps_what_only_a_dropped_column_explains(spark):
    pairs = spark.createDataFrame(
        [(0, 1, "a", "b", 0.99), (1, 2, "b", "c", 0.99), (0, 2, "a", "c", 0.9), (3, 4, "d", "e", -0.97)],
        "position_a int, position_b int, column_a string, column_b string, r double",
    )
    assert correlation.redundant_columns(pairs) == ["b", "e"]


@pytest.mark.parametrize("bracket_rows", [10, 200, 10**6])
def test_quantiles_are_exact_with_hot_values(spark, bracket_rows):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(4000, 3.0), rng.lognormal(0, 3, 6000), [NAN, math.inf]])
    frame = pd.DataFrame({"Clase": np.where(rng.random(len(x)) < 0.3, "Benigno", "Ataque"), "x": x, "y": rng.normal(size=len(x))})
    values = distribution.long_values(spark.createDataFrame(frame).repartition(6), "Clase", ["x", "y", "absent"])
    shares = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = distribution.exact_quantiles(values, shares, bracket_rows)
    finite = frame[np.isfinite(frame.x)]
    for (group, variable, share), value in got.items():
        source = finite if variable == "x" else frame
        assert value == pytest.approx(np.quantile(source.loc[source.Clase == group, variable], share), rel=1e-12)
    assert len(got) == 2 * 2 * len(shares)


@pytest.mark.parametrize("bracket_rows", [3, 500])
def test_missed_ranks_are_found_by_exact_counts(spark, monkeypatch, bracket_rows):
    """A sketch that is wrong everywhere: no bracket holds its rank at first, and none is ever ranked whole."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.full(2000, 3.0), rng.lognormal(0, 3, 4000), -rng.lognormal(0, 200, 300), [0.0, -0.0, 5e-324, 1.7e308, -1.7e308]])
    frame = pd.DataFrame({"Clase": [None if i % 3 else "a" for i in range(len(x))], "x": x})
    values = distribution.long_values(spark.createDataFrame(frame).repartition(5), "Clase", ["x"])
    ranked, plain = [], distribution.ranked_values

    def watched(values, brackets):
        ranked.append([b for b in brackets])
        return plain(values, brackets)

    monkeypatch.setattr(distribution, "ranked_values", watched)
    monkeypatch.setattr(distribution, "narrow_large", lambda values, brackets, *_: [distribution.Bracket(*b.key, b.total, 1, 1e5, 1e5) for b in brackets])
    got = distribution.exact_quantiles(values, (0.0, 0.1, 0.5, 0.9, 1.0), bracket_rows)
    assert len(got) == 10 and len(ranked) == 2 and all(b.rows <= bracket_rows or b.low == b.high for b in ranked[1])
    for (group, _, share), value in got.items():
        own = frame.x[frame.Clase.isna() if group is None else frame.Clase == group]
        assert value == pytest.approx(np.quantile(own, share), rel=1e-12)


def test_correlation_sends_a_row_a_task(spark):
    df = spark.range(0, 1000, 1, 40).selectExpr("id * 1.0 as a", "rand(1) as b", "id * -2.0 as c")
    found = correlation.correlation(df, ["a", "b", "c"])
    assert found.rdd.getNumPartitions() == 1 and {(r["column_a"], r["column_b"]) for r in found.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert found.filter("column_a = 'a' and column_b = 'c'").first()["r"] == pytest.approx(-1.0, abs=1e-12)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_whiskers_never_enter_the_box(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 10.0, 11.0, 12.0, 100.0)] + [("b", 1.0)], "Clase string, v double")
    got = {r["class"]: r for r in distribution.box_statistics(df, "Clase", ["v"]).collect()}
    assert (got["a"]["q1"], got["a"]["whisker_low"], got["a"]["whisker_high"], got["a"]["outliers"]) == (10.0, 10.0, 12.0, 2)
    assert (got["b"]["q1"], got["b"]["whisker_high"], got["b"]["outliers"]) == (1.0, 1.0, 0)


def test_density_matches_the_exact_curve(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(2.0, 3.0, 5000)
    df = spark.createDataFrame(pd.DataFrame({"Clase": "Benigno", "v": x}))
    got = distribution.density(df, "Clase", ["v"]).orderBy("point").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 200)
    exact = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose(got["x"], grid)
    assert np.allclose(got["density"], exact, atol=2e-4 * exact.max())


def test_histogram_shares_sum_to_one_and_flat_classes_have_one_bin(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 4.0)] * 3, "Clase string, v double")
    bars = distribution.histogram(df, "Clase", ["v"], bins=10)
    totals = {r["class"]: (r["bins"], r["share"]) for r in bars.groupBy("class").agg(F.count("bin").alias("bins"), F.sum("share").alias("share")).collect()}
    assert totals["a"] == (10, pytest.approx(1.0)) and totals["b"] == (1, 1.0)
