"""Random forest and multilayer perceptron pipelines, scoring and feature importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.tables import local_table
from flowsieve.functions.values import col
from flowsieve.operators import forests, networks
from flowsieve.operators.blocks import Scaling
from flowsieve.operators.features import LABEL_INDEX, RAW_VECTOR, VECTOR, assembler, label_indexer, scaler

# Tables of more rows are fitted from rows packed into blocks, in passes over them, by forests of the same kind and networks of the same form.
ROWS_AS_OBJECTS = 1_000_000
# A label of more classes than this, or other settings than usual, leave a large forest to MLlib.
MOST_LABELS = 256
# MLlib keeps a number a tree with every row of a fit, besides one a feature: more rows than this are fitted so many trees at a time.
# Fewer at a time keep less, but each part works the rows out again.
ROWS_WITH_ALL_TREES, TREES_AT_ONCE = 5_000_000, 50
SEED_STEP = 1_000_003
# Memory for node statistics per pass: a deep forest takes fewer passes over the data with more.
NODE_MEMORY_MB = 512


def forest(vector: str, trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=LABEL_INDEX,
        featuresCol=vector,
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        maxMemoryInMB=NODE_MEMORY_MB,
    )


def forest_large(
    features: Sequence[str],
    label: str = N.LABEL,
    trees: int = N.FOREST_LARGE["trees"],
    depth: int = N.FOREST_LARGE["depth"],
    seed: int = N.FOREST_SEED,
) -> Pipeline:
    """Index, assemble, scale by deviation, forest."""
    return Pipeline(stages=[label_indexer(label), assembler(features), scaler(center=False), forest(VECTOR, trees, depth, seed)])


def forest_light(
    features: Sequence[str],
    label: str = N.LABEL,
    trees: int = N.FOREST_LIGHT["trees"],
    depth: int = N.FOREST_LIGHT["depth"],
    seed: int = N.FOREST_SEED,
) -> Pipeline:
    """Index, assemble, forest on the raw values."""
    return Pipeline(stages=[label_indexer(label), assembler(features), forest(RAW_VECTOR, trees, depth, seed)])


def fit_forest(pipeline: Pipeline, train: DataFrame, at_once: int | None = None) -> PipelineModel:
    """Fit a pipeline that ends in a forest.

    A large table is fitted from its binned rows (`forests`), a small one by MLlib. With `at_once` MLlib fits so many trees at a time, so that
    the rows that it keeps are smaller; so it does without, if a large table has settings that `forests` does not build. Every tree is
    drawn and grown from all rows as in one fit; the parts of the forest have seeds of their own.
    """
    *before, whole = pipeline.getStages()
    trees = whole.getNumTrees()
    if at_once is None:
        rows = train.count()
        if rows > ROWS_AS_OBJECTS and forests.supported(whole) and [type(s) for s in before] in ([StringIndexer, VectorAssembler], [StringIndexer, VectorAssembler, StandardScaler]):
            prepared = Pipeline(stages=before).fit(train)
            index, vectors, *scaled = prepared.stages
            if len(index.labels) <= MOST_LABELS:
                grown = forests.fit_binned(whole, index.transform(train), rows, index.getOutputCol(), vectors.getInputCols(), len(index.labels), Scaling.of(*scaled or [None]))
                return PipelineModel([*prepared.stages, grown])
        at_once = trees if trees <= TREES_AT_ONCE or rows <= ROWS_WITH_ALL_TREES else TREES_AT_ONCE
    if at_once >= trees:
        return pipeline.fit(train)
    if whole.getFeatureSubsetStrategy() == "auto":  # of a part with one tree, MLlib would take it for all features
        whole = whole.copy({whole.featureSubsetStrategy: "sqrt"})
    prepared = Pipeline(stages=before).fit(train)
    rows = prepared.transform(train)
    parts = [whole.copy({whole.numTrees: min(at_once, trees - i), whole.seed: whole.getSeed() + SEED_STEP * i}) for i in range(0, trees, at_once)]
    return PipelineModel([*prepared.stages, join_forests([part.fit(rows) for part in parts])])


def join_forests(forests: Sequence[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest with the trees of all, in order, and the settings of the first."""
    context, first = SparkContext._active_spark_context, forests[0]
    classes = context._jvm.org.apache.spark.ml.classification
    trees = [tree._java_obj for forest in forests for tree in forest.trees]
    array = context._gateway.new_array(classes.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    whole = classes.RandomForestClassificationModel(first.uid, array, first.numFeatures, first.numClasses)
    joined = RandomForestClassificationModel(first._java_obj.copyValues(whole, context._jvm.org.apache.spark.ml.param.ParamMap.empty()))
    joined._resetUid(first.uid)
    joined._transfer_params_from_java()
    joined._set(numTrees=len(trees))
    joined._transfer_params_to_java()
    return joined


def fit_perceptron(
    train: DataFrame,
    features: Sequence[str],
    label: str = N.LABEL,
    hidden: Sequence[int] = N.PERCEPTRON["hidden"],
    block: int = N.PERCEPTRON["block"],
    iterations: int = N.PERCEPTRON["iterations"],
    seed: int = N.PERCEPTRON_SEED,
) -> PipelineModel:
    """Index, assemble, standardise, perceptron.

    The size of the output layer is the number of labels the fitted indexer holds. The perceptron of a large table is fitted from rows packed
    into blocks (`networks`), in as many passes as MLlib makes over its own.
    """
    indexer = label_indexer(label).fit(train)
    network = MultilayerPerceptronClassifier(
        labelCol=LABEL_INDEX,
        featuresCol=VECTOR,
        layers=[len(features), *hidden, len(indexer.labels)],
        blockSize=block,
        maxIter=iterations,
        seed=seed,
    )
    if train.count() > ROWS_AS_OBJECTS and len(indexer.labels) > 1:
        prepared = Pipeline(stages=[assembler(features), scaler(center=True)]).fit(train)
        fitted = networks.fit_packed(network, indexer.transform(train), indexer.getOutputCol(), features, Scaling.of(prepared.stages[-1]))
        return PipelineModel([indexer, *prepared.stages, fitted])
    rest = Pipeline(stages=[assembler(features), scaler(center=True), network])
    return PipelineModel([indexer, *rest.fit(indexer.transform(train)).stages])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def preview(scored: DataFrame, label: str = N.LABEL, rows: int = 10) -> DataFrame:
    """Label, its index and the prediction for a few rows."""
    return scored.select(col(label), LABEL_INDEX, "prediction").limit(rows)


def feature_importance(spark: SparkSession, model: PipelineModel, top: int | None = None) -> DataFrame:
    """Importance per feature, largest first; stages are found by kind, not by place."""
    inputs = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    trees = next(s for s in model.stages if isinstance(s, RandomForestClassificationModel))
    weights = [float(w) for w in trees.featureImportances.toArray()]
    table = local_table(spark, list(zip(inputs, weights)), {"feature": "string", "importance": "double"})
    ranked = table.orderBy(F.desc("importance"), "feature")
    return ranked if top is None else ranked.limit(top)
