"""Label indexing, vector assembly and scaling as `pyspark.ml` stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.values import col

LABEL_INDEX, RAW_VECTOR, VECTOR = "label_index", "features_vector", "features_scaled"


def label_indexer(label: str = N.LABEL, into: str = LABEL_INDEX, handle_invalid: str = "skip") -> StringIndexer:
    """Index by falling frequency, ties by label. Rows with a label not seen in training are skipped."""
    return StringIndexer(inputCol=label, outputCol=into, handleInvalid=handle_invalid)


def assembler(features: Sequence[str], into: str = RAW_VECTOR) -> VectorAssembler:
    """Features to one vector; null and NaN are errors, so clean the rows first."""
    return VectorAssembler(inputCols=list(features), outputCol=into)


def scaler(center: bool, source: str = RAW_VECTOR, into: str = VECTOR) -> StandardScaler:
    """Divide by the sample deviation, after removing the mean if `center`."""
    return StandardScaler(inputCol=source, outputCol=into, withStd=True, withMean=center)


def index_labels(df: DataFrame, label: str = N.LABEL, into: str = LABEL_INDEX) -> DataFrame:
    """Every row with the index of its label; a null label is an error, as no row may vanish unseen."""
    return label_indexer(label, into, handle_invalid="error").fit(df).transform(df)


def assemble(df: DataFrame, features: Sequence[str], into: str = RAW_VECTOR) -> DataFrame:
    return assembler(features, into).transform(df)


def scale(df: DataFrame, features: Sequence[str], center: bool = False) -> DataFrame:
    """Fit and apply the scaler, adding the raw and the scaled vector."""
    return Pipeline(stages=[assembler(features), scaler(center)]).fit(df).transform(df)


def vector_columns(df: DataFrame, vector: str, columns: Sequence[str]) -> DataFrame:
    """A vector spread to one double column per name; the table's columns of the same names give way."""
    spread = df.drop(*columns).withColumn("__values", vector_to_array(col(vector)))
    return spread.withColumns({c: F.col("__values")[i] for i, c in enumerate(columns)}).drop("__values")


def indexer_of(model: PipelineModel) -> StringIndexerModel:
    return next(stage for stage in model.stages if isinstance(stage, StringIndexerModel))


def unseen_labels(model: PipelineModel, df: DataFrame, label: str = N.LABEL) -> DataFrame:
    """Rows per label that scoring skips, because training saw none of that label."""
    seen = list(indexer_of(model).labels)
    skipped = df.filter(col(label).isNull() | ~col(label).isin(seen))
    return skipped.groupBy(col(label).alias(label)).agg(F.count(F.lit(1)).alias("skipped"))
