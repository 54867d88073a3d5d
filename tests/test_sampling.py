from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from flowsieve.functions.draws import key_draw
from flowsieve.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    label = F.when(F.col("id") % 10 < 8, "Benign").when(F.col("id") % 10 == 8, "Bot").otherwise(F.lit(None))
    return spark.range(5000).withColumn("Label", label).cache()


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(shares=st.lists(st.floats(0.05, 1.0), min_size=2, max_size=4), seed=st.integers(0, 10**6))
def test_split_parts_are_disjoint_and_complete(rows, shares, seed):
    parts = [ids(p) for p in sampling.split_keyed(rows, ["id"], shares, seed)]
    assert sorted(sum(parts, [])) == list(range(5000))


def test_keyed_draws_ignore_partitions(rows):
    assert sorted(ids(sampling.sample_keyed(rows, 0.1, ["id"]))) == sorted(ids(sampling.sample_keyed(rows.repartition(13), 0.1, ["id"])))


def test_capped_sample(rows):
    kept = ids(sampling.sample_capped_keyed(rows, 0.5, 100, ["id"]))
    assert len(kept) == 100 and kept == ids(sampling.sample_capped_keyed(rows.repartition(7), 0.5, 100, ["id"]))
    everything = set(ids(sampling.sample_keyed(rows, 0.01, ["id"])))
    assert set(ids(sampling.sample_capped_keyed(rows, 0.01, 10**6, ["id"]))) == everything
    assert ids(sampling.sample_capped_keyed(rows.limit(0), 0.5, 10, ["id"])) == []
    assert sampling.sample_capped(rows, 1.0, 50).count() == 50


@pytest.mark.parametrize("cap", [1, 500, 50_000, 10**7])
def test_capped_sample_comes_from_the_whole_table(spark, cap):
    table = spark.range(0, 1_000_000, 1, 16)
    kept = ids(sampling.sample_capped(table, 0.1, cap))
    drawn = sampling.sample_capped(table, 0.1, 10**9).count()
    assert len(kept) == len(set(kept)) == min(cap, drawn) and 98_000 < drawn < 102_000
    if cap >= 500:
        shares = [sum(i // 62_500 == k for i in kept) / len(kept) for k in range(16)]
        assert min(shares) > 0.02 and max(shares) < 0.11


def test_ties_at_the_cap_are_ranked_by_key(spark):
    table = spark.range(100).selectExpr("id % 10 AS k", "id").withColumn(sampling.DRAW, F.lit(7))
    assert sampling.lowest_draws(table, 3, [F.col("id")]).count() == 3
    assert sorted(ids(sampling.lowest_draws(table, 3, [F.col("id")]))) == [0, 1, 2]


def test_draws_tell_keys_apart(spark):
    keys = [(None, "x"), ("x", None), ("a|b", "c"), ("a", "b|c"), ("", ""), (None, None), ("n", "n")]
    table = spark.createDataFrame(keys, "a string, b string").select(key_draw(["a", "b"], 1).alias("d"))
    assert table.distinct().count() == len(keys)


def test_fractions_never_exceed_one(rows):
    got = {r["Label"]: r["fraction"] for r in sampling.balance_fractions(rows, target=10**9).collect()}
    assert got == {"Benign": 1.0, "Bot": 1.0}


@pytest.mark.parametrize("target", [400, 10**9])
def test_balance_keeps_minorities_and_drops_null_labels(rows, target):
    for kept in (sampling.balance(rows, target=target), sampling.balance_keyed(rows, ["id"], target=target)):
        counts = {r["Label"]: r["count"] for r in kept.groupBy("Label").count().collect()}
        assert counts["Bot"] == 500 and None not in counts
        assert counts["Benign"] == 4000 if target > 4000 else 300 < counts["Benign"] < 500


def test_balance_without_majority(rows):
    others = rows.filter("Label = 'Bot'")
    assert sampling.balance_keyed(others, ["id"], target=5).count() == 500


def test_head_sample_by_order(rows):
    assert ids(sampling.head_sample(rows.repartition(5), 7, ["id"])) == list(range(7))
    assert sampling.head_sample(rows, 7).count() == 7


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(target=st.integers(0, 4500), small=st.integers(0, 600))
def test_exact_balance_takes_the_lowest_draws(rows, target, small):
    targets = {"Benign": target, "Bot": small}
    kept = sampling.balance_exact(rows, ["id"], targets=targets)
    drawn = rows.select("id", "Label", key_draw(["id"], sampling.SAMPLE_SEED).alias("draw")).collect()
    expected = set()
    for name in {r["Label"] for r in drawn} - {None}:
        own = sorted((r["draw"], r["id"]) for r in drawn if r["Label"] == name)
        expected |= {i for _, i in own[: targets.get(name, len(own))]}
    assert sorted(ids(kept)) == sorted(expected) and kept.columns == rows.columns


def test_exact_balance_with_one_key_for_all(spark):
    """All rows share their draw, and half of them are equal; the number is exact all the same, and the same rows stay."""
    df = spark.createDataFrame([(1, "Benign", i // 2) for i in range(100)], "k int, Label string, v int").repartition(7)
    kept = [sorted(r["v"] for r in sampling.balance_exact(part, ["k"], targets={"Benign": 31}).collect()) for part in (df, df.repartition(2))]
    assert len(kept[0]) == 31 and kept[0] == kept[1]


def test_exact_balance_sorts_no_rows_but_ties(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "if(id % 10 = 0, 'Bot', 'Benign') as Label").write.parquet(str(tmp_path / "t"))
    kept = sampling.balance_exact(spark.read.parquet(str(tmp_path / "t")), ["id"], targets={"Benign": 1234})
    assert kept.filter("Label = 'Benign'").count() == 1234 and kept.filter("Label = 'Bot'").count() == 2000
    plain, tied = str(kept._jdf.queryExecution().optimizedPlan().toString()).split("Window")[0], kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plain and "Join" not in tied and tied.count("Window") <= 2


@pytest.mark.parametrize("shares", [(0.7, 0.3), (0.2, 0.5, 0.3), (1.0,), (0.0, 1.0)])
def test_parts_hold_every_row_once_and_draw_once(spark, shares):
    """The first and the last part compare their draw with one bound, so a filter works it out once."""
    rows = spark.range(0, 3000, 1, 3).selectExpr("CASE WHEN id % 9 > 0 THEN id % 1000 END AS k", "id")
    found = sampling.split_keyed(rows, ["k"], shares, 5)
    got = [{r["id"] for r in part.collect()} for part in found]
    assert sum(map(len, got)) == 3000 and set().union(*got) == set(range(3000))
    drawn = rows.withColumn("draw", sampling.key_draw(["k"], 5)).collect()
    ends = [sum(shares[:i]) / sum(shares) * (1 << 32) for i in range(len(shares) + 1)]
    for i, ids in enumerate(got):
        last = i == len(shares) - 1
        assert ids == {r["id"] for r in drawn if r["draw"] >= ends[i] and (last or r["draw"] < ends[i + 1])}
    for part in (found[0], found[-1]):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("md5") <= 1
