"""Forests and perceptrons fitted from packed rows, as large tables are."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from flowsieve.operators import features, forests, models, networks
from flowsieve.operators.blocks import Scaling
from flowsieve.plans import stored, train
from flowsieve.sources.fitted import save_pipeline
from flowsieve.sources.workspace import scratch_path

NAMES = ["x", "y/1", "flat", "few"]


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes that two features decide, in three partitions; ids come twice."""
    df = spark.range(0, 1500, 1, 3).select((F.col("id") % 750).alias("id"), F.rand(3).alias("x"), F.rand(4).alias("y/1"), F.lit(2.0).alias("flat"), (F.col("id") % 5).cast("double").alias("few"))
    return df.withColumn("Label", F.when(F.col("x") > 0.6, "Bot").when(F.col("y/1") > 0.7, "Rare").otherwise("Benign")).cache()


@pytest.fixture()
def large(monkeypatch):
    """Any table is large; MLlib's own fits are errors."""
    monkeypatch.setattr(models, "ROWS_AS_OBJECTS", 100, raising=False)
    for kind in (RandomForestClassifier, MultilayerPerceptronClassifier):
        monkeypatch.setattr(kind, "_fit", lambda self, df: pytest.fail("fitted by MLlib"))


def test_a_large_forest_grows_from_binned_rows(spark, rows, large):
    found = train.train_forest_large(rows, keys=["id"], exclude=["id"], trees=7, depth=5)
    forest = found.model.stages[-1]
    assert found.metrics.first()["accuracy"] > 0.95
    assert forest.getNumTrees == 7 and forest.numClasses == 3 and forest.numFeatures == 4 and forest.getOrDefault("maxDepth") == 5 and forest.getFeaturesCol() == features.VECTOR
    assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 7
    again = stored.evaluate_stored(save_pipeline(found.model, scratch_path(spark, "model"), found.card), rows)
    assert again.scored.select("id", "prediction", "probability").exceptAll(models.score(found.model, rows).select("id", "prediction", "probability")).count() == 0
    weights = {r["feature"]: r["importance"] for r in models.feature_importance(spark, found.model).collect()}
    assert sum(weights.values()) == pytest.approx(1.0) and weights["flat"] == 0 and min(weights["x"], weights["y/1"]) > weights["few"]
    same = train.train_forest_large(rows, keys=["id"], exclude=["id"], trees=7, depth=5)
    assert same.model.stages[-1].toDebugString.split("\n", 1)[1] == forest.toDebugString.split("\n", 1)[1]


def test_a_small_forest_is_mllibs(rows, monkeypatch):
    monkeypatch.setattr(forests, "fit_binned", lambda *a, **k: pytest.fail("not a large table"))
    assert train.train_forest_large(rows, keys=["id"], exclude=["id"], trees=2, depth=2).model.stages[-1].getNumTrees == 2


@pytest.mark.parametrize("cells", [1 << 22, 200])
def test_every_split_is_the_best_of_its_rows(spark, rows, monkeypatch, cells):
    """Against brute force on the rows as drawn for each tree; also if the counts of a tree are too many to take at once."""
    monkeypatch.setattr(forests, "TASK_CELLS", cells)
    monkeypatch.setattr(forests, "ROW_CELLS", cells // 2)
    table = rows.filter("id < 400").coalesce(1).withColumn(features.LABEL_INDEX, F.col("Label").eqNullSafe("Bot").cast("double") + 2 * F.col("Label").eqNullSafe("Rare").cast("double"))
    kept = table.select(*[F.col(f"`{c}`") for c in NAMES], features.LABEL_INDEX).toPandas()
    values, labels = kept[NAMES].to_numpy(), kept[features.LABEL_INDEX].to_numpy().astype(int)
    kind = RandomForestClassifier(labelCol=features.LABEL_INDEX, featuresCol=features.VECTOR, numTrees=3, maxDepth=4, maxBins=8, featureSubsetStrategy="all", seed=-5)
    scaling = Scaling(None, np.array([2.0, 0.5, 0.0, 1.0]))
    model = forests.fit_binned(kind, table, len(kept), features.LABEL_INDEX, NAMES, 3, scaling, block_rows=64)
    points = forests.candidates(table, len(kept), NAMES, scaling, 8, 1)
    scaled = scaling.apply(values.T)

    def gini(w):
        return 1 - (np.bincount(labels, w, 3) ** 2).sum() / w.sum() ** 2 if w.sum() else 0.0

    def check(node, weight):
        assert list(node.impurityStats().stats()) == np.bincount(labels, weight, 3).tolist()
        if node.subtreeDepth() == 0:
            return
        f, threshold = node.split().featureIndex(), node.split().threshold()
        goes = scaled[f] <= threshold
        gains = [gini(weight) - sum(part.sum() * gini(part) for part in (weight * (scaled[j] <= t), weight * (scaled[j] > t))) / weight.sum() for j in range(4) for t in points[j]]
        assert node.gain() == pytest.approx(max(gains)) and threshold in points[f]
        check(node.leftChild(), weight * goes)
        check(node.rightChild(), weight * ~goes)

    for i, tree in enumerate(model.trees):
        weight = np.concatenate([forests.draws(kind.getSeed() & (2**63 - 1), i, b, min(64, len(kept) - 64 * b)) for b in range(-(-len(kept) // 64))]).astype(float)
        assert 0.8 < weight.mean() < 1.2
        check(tree._java_obj.rootNode(), weight)


def test_draws_follow_poisson():
    drawn = np.concatenate([forests.draws(1, 2, block, 50_000) for block in range(20)])
    assert (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=0.002) and (drawn == 2).mean() == pytest.approx(np.exp(-1) / 2, abs=0.002)
    assert drawn.mean() == pytest.approx(1, abs=0.004) and (forests.draws(1, 3, 0, 999) != drawn[:999]).any()


def test_split_points():
    assert forests.split_points(np.array([3.0, 1.0, 1.0, 2.0]), 32).tolist() == [1.5, 2.5]
    assert forests.split_points(np.full(9, 4.0), 32).tolist() == []
    many = forests.split_points(np.arange(3200.0), 32)
    assert len(many) == 31 and np.abs(many - np.arange(100, 3200, 100)).max() <= 1
    assert len(forests.split_points(np.r_[np.zeros(5000), np.arange(1.0, 100)], 8)) <= 7


def test_null_and_nan_are_errors_and_nothing_is_left_behind(spark, rows, large, tmp_path, monkeypatch):
    monkeypatch.setattr("flowsieve.operators.blocks.scratch_path", lambda _, name: str(tmp_path / name))
    train.train_perceptron(rows, named=NAMES, keys=["id"], hidden=(3,), iterations=3)
    kind = RandomForestClassifier(labelCol="few", featuresCol=features.VECTOR, numTrees=2, maxDepth=2)
    with pytest.raises(Exception, match="null or NaN"):
        forests.fit_binned(kind, rows.withColumn("x", F.when(F.col("id") > 3, F.col("x"))), 1500, "few", NAMES, 5, Scaling(None, None))
    assert not list(tmp_path.iterdir())


def test_a_large_perceptron_is_fitted_in_passes(spark, rows, large):
    found = train.train_perceptron(rows, named=NAMES, keys=["id"], hidden=(5,), iterations=80)
    network = found.model.stages[-1]
    assert found.metrics.first()["accuracy"] > 0.95 and network.getOrDefault("layers") == [4, 5, 3] and network.weights.size == 4 * 5 + 5 + 5 * 3 + 3
    again = stored.evaluate_stored(save_pipeline(found.model, scratch_path(spark, "model"), found.card), rows)
    assert again.scored.select("id", "prediction").exceptAll(models.score(found.model, rows).select("id", "prediction")).count() == 0


def test_the_network_is_mllibs(spark, rows):
    """The loss of the same weights over all rows is that of MLlib's probabilities, and the gradient is that of the loss."""
    prepared = models.fit_perceptron(rows, NAMES, hidden=(4, 3), iterations=6)
    scored = prepared.transform(rows).select(features.LABEL_INDEX, "probability").toPandas()
    expected = -np.mean([np.log(p[int(i)]) for i, p in zip(scored[features.LABEL_INDEX], scored["probability"])])
    weights, sizes = prepared.stages[-1].weights.toArray(), [4, 4, 3, 3]
    scaling = Scaling.of(prepared.stages[2])
    encode = lambda columns: networks.halves(scaling.apply(columns).astype(np.float32))
    with networks.packed(prepared.stages[0].transform(rows), features.LABEL_INDEX, NAMES, encode, 100) as blocks:
        value, gradient = networks.mean_loss(blocks, sizes, weights)
        assert value == pytest.approx(expected, rel=1e-5)
        for i in range(0, len(weights), 9):
            step = np.zeros(len(weights))
            step[i] = 1e-2
            slope = (networks.mean_loss(blocks, sizes, weights + step)[0] - networks.mean_loss(blocks, sizes, weights - step)[0]) / 2e-2
            assert gradient[i] == pytest.approx(slope, abs=2e-4)


def test_halves_lose_nothing():
    import pyarrow as pa

    numbers = np.random.default_rng(1).normal(size=(3, 50)).astype(np.float32)
    assert (networks.from_halves(pa.py_buffer(networks.halves(numbers)), 3, 50) == numbers).all()


def test_minimise_finds_the_valley():
    def rosenbrock(x):
        a, b = 1 - x[:-1], x[1:] - x[:-1] ** 2
        gradient = np.zeros(len(x))
        gradient[:-1] += -2 * a - 400 * x[:-1] * b
        gradient[1:] += 200 * b
        return float((a**2 + 100 * b**2).sum()), gradient

    assert networks.minimise(rosenbrock, np.full(6, -1.0), 500, 1e-14) == pytest.approx(np.ones(6), abs=1e-3)
