from __future__ import annotations

import glob
import time

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from flowsieve.functions import names, tables
from flowsieve.operators import features, metrics, models, sampling
from flowsieve.plans import stored, train
from flowsieve.queries import learning
from flowsieve.sources.fitted import load_card, save_pipeline
from flowsieve.sources.workspace import scratch_path

SCORED = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 0), (3, 0)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(float(a), float(b)) for a, b in SCORED], "label double, prediction double")


@pytest.fixture(scope="module")
def points(spark):
    x = F.rand(3)
    df = spark.range(0, 1200, 1, 4).select("id", x.alias("x"), F.rand(4).alias("noise/1"), F.lit(2.0).alias("flat"))
    return df.withColumn("Label", F.when(F.col("x") > 0.6, "Bot").when(F.col("x") > 0.55, "Rare").otherwise("Benign")).cache()


def test_worked_example(scored):
    got = metrics.evaluate(scored, "label").first()
    assert tuple(got) == pytest.approx((0.5, 0.4375, 0.5, 0.4642857142857143))


def test_metrics_equal_the_evaluator(scored):
    got = metrics.evaluate(scored, "label").first().asDict()
    for ours, theirs in {"accuracy": "accuracy", "weighted_precision": "weightedPrecision", "weighted_recall": "weightedRecall", "f1": "f1"}.items():
        assert got[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(scored), abs=1e-15)


def test_nothing_hit(spark):
    wrong = spark.createDataFrame([(0.0, 1.0)], "label double, prediction double")
    assert tuple(metrics.evaluate(wrong, "label").first()) == (0.0, 0.0, 0.0, 0.0)


def test_label_index_ties(spark):
    df = spark.createDataFrame([("z",), ("z",), ("c",), ("a",), ("b",)], "Label string")
    got = {r["Label"]: r["label_index"] for r in features.index_labels(df).collect()}
    assert got == {"z": 0.0, "a": 1.0, "b": 2.0, "c": 3.0}


def test_scaling_a_flat_column_gives_zero(points):
    scaled = features.vector_columns(features.scale(points, ["x", "flat"], center=False), features.VECTOR, ["x", "flat"])
    assert scaled.agg(F.max("flat")).first()[0] == 0.0
    assert scaled.agg(F.stddev_samp("x")).first()[0] == pytest.approx(1.0)


def test_forest_learns_and_survives_storage(spark, points):
    trained = train.train_forest_light(points, exclude=["id"], keys=["id"], trees=5, depth=4)
    assert trained.metrics.first()["accuracy"] > 0.9 and trained.skipped.count() == 0
    path = save_pipeline(trained.model, scratch_path(spark, "model"))
    top = stored.explain_stored(spark, path, 2).collect()
    assert top[0]["feature"] == "x" and len(top) == 2
    assert sum(r["importance"] for r in stored.explain_stored(spark, path).collect()) == pytest.approx(1.0)
    again = stored.evaluate_stored(path, points)
    assert again.metrics.first()["accuracy"] > 0.9
    assert models.preview(again.scored).columns == ["Label", "label_index", "prediction"]


def test_class_seen_only_in_test_is_skipped_and_reported(points):
    known = points.filter("Label <> 'Rare'")
    model = models.forest_large(["x", "flat"], trees=2, depth=2).fit(known)
    trained = train.evaluated(model, points, "Label")
    rare = points.filter("Label = 'Rare'").count()
    assert [(r["Label"], r["skipped"]) for r in trained.skipped.collect()] == [("Rare", rare)]
    assert trained.scored.count() == points.count() - rare


def test_perceptron_output_layer_is_the_number_of_labels(points):
    trained = train.train_perceptron(points, named=["x", "noise/1"], keys=["id"], hidden=(4,), iterations=30)
    assert trained.model.stages[-1].getOrDefault("layers") == [2, 4, 3]
    assert trained.metrics.first()["accuracy"] > 0.8


def test_cached_projection_is_released(spark, scored):
    with metrics.cached_projection(scored, ["label"]) as kept:
        assert kept.count() == 8 and kept.storageLevel.useMemory
    assert not kept.storageLevel.useMemory


def test_keys_label_index_and_excluded_names_are_no_features(points):
    table = points.withColumn("Label_Index", F.when(F.col("Label") == "Bot", 1.0).otherwise(0.0)).withColumn("k", (F.col("id") + F.lit((1 << 53) + 1)).cast("bigint"))
    for found in (
        train.train_forest_large(table, keys=["k"], exclude=["id"], trees=2, depth=2),
        train.train_forest_light(table, keys=["k"], exclude=["id"], trees=2, depth=2),
        train.train_perceptron(table, keys=["k"], exclude=["id"], hidden=(3,), iterations=3),
    ):
        assert found.features == ["x", "noise/1", "flat"]


@pytest.mark.parametrize("trainer", [train.train_forest_large, train.train_forest_light])
def test_held_out_rows_are_those_of_the_keyed_split(points, trainer):
    table = points.withColumn("k", (F.col("id") + F.lit((1 << 53) + 1)).cast("bigint"))
    scored = {r["k"] for r in trainer(table, keys=["k"], exclude=["id"], trees=2, depth=2).scored.collect()}
    assert scored == {r["k"] for r in sampling.split_keyed(table, ["k"])[1].collect()}


def test_null_labels_are_reported_or_an_error(points):
    table = points.withColumn("Label", F.when(F.col("id") % 10 > 0, F.col("Label")))
    found = train.train_forest_large(table, keys=["id"], trees=2, depth=2)
    counts = [part.filter("Label is null").count() for part in sampling.split_keyed(table, ["id"])]
    assert [(r["Label"], r["skipped"]) for r in found.skipped_training.collect()] == [(None, counts[0])]
    assert [(r["Label"], r["skipped"]) for r in found.skipped.collect()] == [(None, counts[1])]
    with pytest.raises(Exception, match="NULL"):
        features.index_labels(table).collect()


def stored_forest(spark, points, **keys):
    trained = train.train_forest_light(points, exclude=["id"], trees=3, depth=3, data="points-v1", **keys)
    return save_pipeline(trained.model, scratch_path(spark, "model"), trained.card), trained


def test_the_card_comes_back(spark, points):
    path, trained = stored_forest(spark, points, keys=["id"])
    card = load_card(spark, path)
    assert card == trained.card and card.features == ["x", "noise/1", "flat"] == card.finite and card.keys == ["id"] and card.data == "points-v1"
    assert stored.evaluate_stored(path, points).scored.count() == points.count()


def test_training_rows_are_left_out(spark, points):
    """Of the whole table, and of one with more rows, in which two have no finite feature and others a new label."""
    path, trained = stored_forest(spark, points, keys=["id"])
    whole = stored.evaluate_unseen(spark, path, points)
    held_out = trained.scored.count()
    assert tuple(whole.report.first()) == (1200, 1200 - held_out, 0, 0, held_out)
    assert tuple(whole.metrics.first()) == tuple(trained.metrics.first())
    test = sampling.split_keyed(points, ["id"])[1]
    spoiled = [r["id"] for r in test.orderBy("id").limit(5).collect()]
    odd = points.withColumn("x", F.when(F.col("id").isin(spoiled[:2]), F.lit(float("nan"))).otherwise(F.col("x")))
    odd = odd.withColumn("Label", F.when(F.col("id").isin(spoiled[2:4]), "New").when(F.col("id") == spoiled[4], None).otherwise(F.col("Label")))
    assert tuple(stored.evaluate_unseen(spark, path, odd).report.first()) == (1200, 1200 - held_out, 2, 3, held_out - 5)


def test_missing_features_are_named(spark, points):
    path, _ = stored_forest(spark, points, keys=["id"])
    with pytest.raises(ValueError, match=r"lacks: \['x', 'id'\]; not numbers: \['flat \(string\)'\]"):
        stored.evaluate_unseen(spark, path, points.drop("x", "id").withColumn("flat", F.lit("2")))


def test_a_model_without_keys_cannot_tell_its_rows(spark, points):
    path, _ = stored_forest(spark, points)
    with pytest.raises(ValueError, match="cannot be told"):
        stored.evaluate_unseen(spark, path, points)
    assert stored.evaluate_unseen(spark, path, points, overlap=True).report.first()["scored"] == 1200


def test_metrics_query_scores_once(spark, points, monkeypatch):
    """All answers are taken from one cached projection of the scored rows."""
    _, trained = stored_forest(spark, points, keys=["id"])
    looked = spark.sparkContext.accumulator(0)

    def count(value):
        looked.add(1)
        return value

    counted = trained.scored.withColumn("prediction", F.udf(count, "double")("prediction"))
    assert learning.agreed(counted).first()["as_evaluator"] and looked.value == trained.scored.count()


def lineitem(spark, rows):
    """Lines of which every seventh stands twice and every eleventh has a null in its key."""
    ids = spark.range(rows)
    lines = ids.unionByName(ids.filter("id % 7 = 0")).selectExpr(
        "CASE WHEN id % 11 > 0 THEN id END AS l_orderkey",
        "id % 13 AS l_partkey",
        "id % 5 AS l_suppkey",
        "CAST(id % 7 + 1 AS INT) AS l_linenumber",
        "CAST(id % 50 AS DOUBLE) AS l_quantity",
        "CAST(id % 900 AS DOUBLE) AS l_extendedprice",
        "id % 10 / 100D AS l_discount",
        "id % 8 / 100D AS l_tax",
        "'R' AS l_returnflag",
    )
    folder = scratch_path(spark, "lines")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    return folder, lines


def test_training_rows_are_stored_without_their_features(spark):
    """The few columns that the records come from are laid out; labels and features are worked out when they are read."""
    folder, lines = lineitem(spark, 500)
    stored_rows = spark.read.parquet(learning.decided_path(spark, folder))
    assert stored_rows.columns == learning.DECIDED_FROM
    expected = lines.selectExpr(*learning.NUMBER_KEY, f"{learning.DECIDED_LABEL} AS Label").toPandas()
    found = learning.decided(spark, folder)
    assert sorted(map(str, found.select(*learning.NUMBER_KEY, "Label").toPandas().values.tolist())) == sorted(map(str, expected.values.tolist()))
    assert set(names.FEATURES) < set(found.columns)


def test_files_stay_apart_while_a_fit_reads_them(spark):
    """Spark puts small files together, and a fit would keep their rows as one block."""
    path = scratch_path(spark, "files")
    spark.range(0, 4000, 1, 40).write.parquet(path)
    before = spark.read.parquet(path).rdd.getNumPartitions()
    with tables.read_splits(spark, 1 << 10):
        assert spark.read.parquet(path).rdd.getNumPartitions() == 40
    assert spark.read.parquet(path).rdd.getNumPartitions() == before < 40


def test_a_fit_keeps_a_partition_for_each_file(spark, monkeypatch):
    """The trainer sees the files apart, and the session's setting comes back, also after an error."""
    folder, _ = lineitem(spark, 600)
    monkeypatch.setattr(learning, "DECIDED_ROWS", 20)
    monkeypatch.setattr(learning, "FIT_SPLIT", 1 << 10)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def trainer(df):
        assert df.rdd.getNumPartitions() > 20
        raise LookupError

    monkeypatch.setitem(learning.TRAINERS, "large", trainer)
    with pytest.raises(LookupError):
        learning.trained(spark, folder, "large")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_a_forest_fitted_in_parts_is_one_forest(spark, points):
    whole = models.forest_large(["x", "noise/1", "flat"], trees=5, depth=3)
    model = models.fit_forest(whole, points, at_once=2)
    joined = model.stages[-1]
    assert joined.getNumTrees == 5 and joined.numClasses == 3 and joined.getFeaturesCol() == features.VECTOR
    first = models.forest_large(["x", "noise/1", "flat"], trees=2, depth=3).fit(points).stages[-1]
    assert [t.toDebugString.split("\n", 1)[1] for t in joined.trees[:2]] == [t.toDebugString.split("\n", 1)[1] for t in first.trees]
    assert len({t.toDebugString.split("\n", 1)[1] for t in joined.trees}) > 2
    found = train.evaluated(model, points, "Label")
    assert found.metrics.first()["accuracy"] > 0.9
    again = stored.evaluate_stored(save_pipeline(model, scratch_path(spark, "model")), points)
    assert again.scored.select("id", "prediction", "probability").exceptAll(found.scored.select("id", "prediction", "probability")).count() == 0
    assert sum(r["importance"] for r in models.feature_importance(spark, model).collect()) == pytest.approx(1.0)


def test_a_large_table_is_fitted_some_trees_at_a_time(points, monkeypatch):
    asked, fit = [], models.RandomForestClassifier._fit
    monkeypatch.setattr(models.RandomForestClassifier, "_fit", lambda self, df: asked.append((self.getNumTrees(), self.getSeed())) or fit(self, df))
    monkeypatch.setattr(models, "TREES_AT_ONCE", 2, raising=False)
    monkeypatch.setattr(models, "ROWS_WITH_ALL_TREES", points.count(), raising=False)
    train.train_forest_large(points, exclude=["id"], trees=5, depth=2)
    monkeypatch.setattr(models, "ROWS_WITH_ALL_TREES", 100, raising=False)
    found = train.train_forest_large(points, exclude=["id"], trees=5, depth=2)
    assert [n for n, _ in asked] == [5, 2, 2, 1] and len({seed for _, seed in asked[1:]}) == 3
    assert found.model.stages[-1].getNumTrees == 5


def test_shuffle_files_go_while_a_fit_runs(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [str(f) for f in env.blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}

    before = shuffled()
    with tables.release_shuffles(spark, every=0.5):
        spark.range(0, 20000, 1, 4).repartition(5, "id").write.format("noop").mode("overwrite").save()
        written = shuffled() - before
        end = time.time() + 20
        while written & shuffled() and time.time() < end:
            time.sleep(0.2)
        assert written and not written & shuffled()
