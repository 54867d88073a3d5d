"""Explain and evaluate a stored model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.tables import local_table
from flowsieve.functions.values import INFINITY, col, field_types
from flowsieve.operators import features, metrics, models, sampling
from flowsieve.plans.train import Trained, evaluated
from flowsieve.sources.fitted import ModelCard, load_card, load_pipeline


def explain_stored(spark: SparkSession, path: str, top: int = 20) -> DataFrame:
    """The most important features of a stored forest."""
    return models.feature_importance(spark, load_pipeline(path), top)


def evaluate_stored(path: str, held_out: DataFrame, label: str = N.LABEL) -> Trained:
    """Score a dataset the model was not trained on, such as the held-out part of a keyed split."""
    return evaluated(load_pipeline(path), held_out, label)


@dataclass
class Checked:
    """Metrics of a stored model on rows that it has not seen, the scored rows, and what became of the others.

    `report` has one row: rows, trained_on (left out as training rows), not_finite (left out by the model's cleaning), unseen_label, scored.
    """

    metrics: DataFrame
    scored: DataFrame
    report: DataFrame


def require_columns(df: DataFrame, card: ModelCard) -> None:
    """An error that lists every column the model needs and the table lacks or holds as something other than numbers."""
    types = field_types(df)
    needed = [*card.features, *(card.finite or ())]
    absent = [c for c in dict.fromkeys([card.label, *needed, *(card.keys or ())]) if c not in types]
    wrong = [f"{c} ({types[c].simpleString()})" for c in dict.fromkeys(needed) if c in types and not isinstance(types[c], T.NumericType)]
    if absent or wrong:
        raise ValueError(f"the model needs columns that the table lacks: {absent}; not numbers: {wrong}")


def evaluate_unseen(spark: SparkSession, path: str, df: DataFrame, overlap: bool = False) -> Checked:
    """Evaluate a stored model on any table, also the one it was trained on: rows that its card tells to be training rows are left out.

    A row is known by its key, whatever table it stands in, so a later version of the training table works as well. A new row whose
    draw falls into the training share is left out too, as it cannot be told from one that was there. A model without keys raises, unless
    `overlap` says that rows it was trained on may be counted. The table is scored once.
    """
    card, model = load_card(spark, path), load_pipeline(path)
    require_columns(df, card)
    if not card.keys and not overlap:
        raise ValueError("the model was split by the layout of its table: its training rows cannot be told")
    seen = list(features.indexer_of(model).labels)
    numbers = [col(c).cast("double").alias(c) for c in dict.fromkeys([*card.features, *(card.finite or ())])]
    others = [col(c) for c in df.columns if c not in {*card.features, *(card.finite or ()), card.label}]
    rows = df.select(*others, col(card.label).cast("string").alias(card.label), *numbers)
    if card.keys and not overlap:
        trained_on = sampling.in_part(card.keys, card.shares, card.seed, 0)
    else:
        trained_on = F.lit(False)
    finite = F.lit(True)
    for c in card.finite or ():
        finite = finite & F.coalesce(F.abs(col(c)) < INFINITY, F.lit(False))
    known = F.coalesce(col(card.label).isin(seen), F.lit(False))
    state = F.when(trained_on, "trained_on").when(~finite, "not_finite").when(~known, "unseen_label").otherwise("scored")
    states = ["trained_on", "not_finite", "unseen_label", "scored"]
    left = rows.filter(state == "scored")
    if card.finite is None:
        left = left.withColumns({c: F.when(F.abs(col(c)) < INFINITY, col(c)).otherwise(F.lit(0.0)) for c in card.features})
    scored = models.score(model, left)
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(state == s).alias(s) for s in states]).first()
    report = local_table(spark, [tuple(counts)], {c: "bigint" for c in ["rows", *states]})
    return Checked(metrics.evaluate(scored), scored, report)
