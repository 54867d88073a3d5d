"""Train on one part, evaluate on the other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from flowsieve.functions import names as N
from flowsieve.functions.values import col
from flowsieve.operators import clean, features, metrics, models, sampling
from flowsieve.sources.fitted import ModelCard


@dataclass
class Trained:
    """A fitted pipeline, the features it uses, the scored held-out rows, their metrics, and the rows
    per label that scoring (`skipped`) and training (`skipped_training`) left out. `card` says how it was trained."""

    model: PipelineModel
    features: list[str]
    scored: DataFrame
    metrics: DataFrame
    skipped: DataFrame
    skipped_training: DataFrame
    card: ModelCard | None = None


def parts(df: DataFrame, keys: Sequence[str] | None, shares: Sequence[float], seed: int) -> list[DataFrame]:
    """The split of the unchanged table, so that `split_keyed` of the same table gives the same held-out rows."""
    return sampling.split_keyed(df, keys, shares, seed) if keys else sampling.split(df, shares, seed)


def never_features(label: str, exclude: Sequence[str], keys: Sequence[str] | None) -> list[str]:
    return [label, *N.NOT_FEATURES, *exclude, *(keys or ())]


def card_of(label: str, chosen: Sequence[str], keys: Sequence[str] | None, shares: Sequence[float], seed: int, finite: Sequence[str] | None, data: str | None) -> ModelCard:
    return ModelCard(label, list(chosen), list(keys) if keys else None, list(shares), seed, None if finite is None else list(finite), data)


def evaluated(
    model: PipelineModel, test: DataFrame, label: str, chosen: Sequence[str] = (), training: DataFrame | None = None, card: ModelCard | None = None
) -> Trained:
    scored = models.score(model, test)
    skipped = [features.unseen_labels(model, part, label) for part in (test, test.limit(0) if training is None else training)]
    return Trained(model, list(chosen), scored, metrics.evaluate(scored), *skipped, card)


def train_forest_large(
    df: DataFrame, label: str = N.LABEL, exclude: Sequence[str] = (), keys: Sequence[str] | None = None, cache: bool = False, data: str | None = None, **settings: int
) -> Trained:
    """Zero for every null, NaN and infinity; all features; scaled; large forest."""
    unused = never_features(label, exclude, keys)
    chosen = clean.feature_names(df, unused)
    train, test = (clean.fill_nonfinite(clean.label_to_string(part, label), label, keep=unused) for part in parts(df, keys, N.FOREST_SPLIT, N.FOREST_SEED))
    model = fit(train, [label, *chosen], lambda kept: models.fit_forest(models.forest_large(chosen, label, **settings), kept), cache)
    return evaluated(model, test, label, chosen, train, card_of(label, chosen, keys, N.FOREST_SPLIT, N.FOREST_SEED, None, data))


def train_forest_light(
    df: DataFrame, label: str = N.LABEL, exclude: Sequence[str] = (), keys: Sequence[str] | None = None, cache: bool = False, data: str | None = None, **settings: int
) -> Trained:
    """Rows with null, NaN or infinity removed; redundant features left out; light forest."""
    unused = never_features(label, exclude, keys)
    chosen = clean.feature_names(df, [*unused, *N.REDUNDANT])
    train, test = (clean.drop_nonfinite_rows(part, unused) for part in parts(df, keys, N.FOREST_SPLIT, N.FOREST_SEED))
    model = fit(train, [label, *chosen], lambda kept: models.forest_light(chosen, label, **settings).fit(kept), cache)
    return evaluated(model, test, label, chosen, train, card_of(label, chosen, keys, N.FOREST_SPLIT, N.FOREST_SEED, clean.feature_names(df, unused), data))


def train_perceptron(
    df: DataFrame,
    label: str = N.LABEL,
    named: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    keys: Sequence[str] | None = None,
    cache: bool = False,
    data: str | None = None,
    **settings,
) -> Trained:
    """Rows with null, NaN or infinity removed; standardised; perceptron. Features by name or by rule."""
    chosen = clean.require_features(df, named) if named else clean.feature_names(df, never_features(label, exclude, keys))
    unused = [c for c in df.columns if c not in chosen]
    train, test = (clean.drop_nonfinite_rows(part, unused) for part in parts(df, keys, N.PERCEPTRON_SPLIT, N.PERCEPTRON_SEED))
    model = fit(train, [label, *chosen], lambda kept: models.fit_perceptron(kept, chosen, label, **settings), cache)
    return evaluated(model, test, label, chosen, train, card_of(label, chosen, keys, N.PERCEPTRON_SPLIT, N.PERCEPTRON_SEED, clean.feature_names(df, unused), data))


def fit(train: DataFrame, columns: Sequence[str], fitting: Callable[[DataFrame], PipelineModel], cache: bool = False) -> PipelineModel:
    """Fit on the label and the features alone.

    A fit reads its rows several times (label counts, moments, split points, trees). With `cache` they are kept in
    memory, and on disk beyond it, while it runs: for data that fits there. Otherwise the source is read again.
    """
    if not cache:
        return fitting(train.select(*[col(c) for c in columns]))
    with metrics.cached_projection(train, columns) as kept:
        return fitting(kept)
