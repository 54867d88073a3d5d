"""Mergeable summaries that are stored with a dataset: one scan when rows arrive, none for the questions asked later.

Quantile sketches answer with a rank error that their size sets, and merge without adding to it; frequent-item sketches nominate every
label above a share, whose rows are then counted exactly; distinct-count sketches have a relative error. All are
aggregated per task before the shuffle, and a group's sketch is a few kilobytes whatever its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.values import col, finite
from flowsieve.operators.distribution import GROUP, QUARTILES, VALUE, VARIABLE

SKETCH_SIZE = 1000
GRID = 500
DISTINCT_BITS = 14


def rank_error(size: int = SKETCH_SIZE) -> float:
    """How far the rank of an answer may be from the one asked for, as a share of the rows.

    Three times the error that a sketch of this size stays below in 99 of 100 cases.
    """
    return 3 * 2.296 / size**0.9723


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """How far an estimated number of distinct values may be off, as a share of it: five standard errors."""
    return 5 * 1.04 / 2 ** (bits / 2)


# --- quantiles


def quantile_sketches(df: DataFrame, group: str = N.BINARY_COLUMN, variables: Sequence[str] = tuple(N.BOX_COLUMNS), by: str | None = None, size: int = SKETCH_SIZE) -> DataFrame:
    """(part, class, variable, n, low, high, sketch) of the finite values, per class and variable and per value of `by`, such as a file."""
    part = (col(by) if by else F.lit(None)).cast("string").alias("part")
    present = [v for v in variables if v in df.columns]
    narrow = df.select(part, col(group).cast("string").alias(GROUP), *[col(v).cast("double").alias(v) for v in present])
    named = narrow.unpivot(["part", GROUP], [col(v) for v in present], VARIABLE, VALUE).filter(finite(VALUE))
    return named.groupBy("part", GROUP, VARIABLE).agg(
        F.count(VALUE).alias("n"), F.min(VALUE).alias("low"), F.max(VALUE).alias("high"), F.kll_sketch_agg_double(VALUE, F.lit(size)).alias("sketch")
    )


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch per class and variable from those of all parts."""
    return sketches.groupBy(GROUP, VARIABLE).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, shares: Sequence[float] = QUARTILES) -> DataFrame:
    """(class, variable, n, share, value): values whose ranks are at most `rank_error` from the shares."""
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("value")) for q in shares]))
    return merged_sketches(sketches).select(GROUP, VARIABLE, "n", asked.alias("asked")).select(GROUP, VARIABLE, "n", "asked.*")


def sketched_boxes(sketches: DataFrame) -> DataFrame:
    """The box table from stored sketches, without a scan of rows: quartiles, fences cut to the range, and about how many values are outside."""
    q = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for name, share in zip(("q1", "median", "q3"), QUARTILES)}
    boxes = merged_sketches(sketches).withColumns(q)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.greatest(F.col("low"), F.col("q1") - reach), F.least(F.col("high"), F.col("q3") + reach)
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]))
    outside = F.size(F.filter("grid", lambda v: (v < F.col("fence_low")) | (v > F.col("fence_high")))) / (GRID + 1)
    fenced = boxes.select(GROUP, VARIABLE, "n", *q, low.alias("fence_low"), high.alias("fence_high"), grid.alias("grid"))
    return fenced.withColumn("outliers", F.round(F.col("n") * outside).cast("bigint")).drop("grid")


# --- labels


def label_sketches(df: DataFrame, label: str = N.LABEL, by: str | None = None, tracked: int = 1024, bits: int = DISTINCT_BITS) -> DataFrame:
    """(part, n, frequent, distinct): sketches of the labels as text, null left out, per value of `by`."""
    rows = df.select((col(by) if by else F.lit(None)).cast("string").alias("part"), col(label).cast("string").alias("label")).filter("label IS NOT NULL")
    frequent = F.expr(f"approx_top_k_accumulate(label, {tracked})")
    return rows.groupBy("part").agg(F.count("label").alias("n"), frequent.alias("frequent"), F.hll_sketch_agg("label", bits).alias("distinct"))


def distinct_labels(sketches: DataFrame) -> DataFrame:
    """(n, labels): rows, and the estimated number of different labels in all parts, with at most `distinct_error`."""
    return sketches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("distinct")), F.lit(0)).alias("labels"))


def frequent_labels(df: DataFrame, sketches: DataFrame, share: float, label: str = N.LABEL, tracked: int = 1024) -> DataFrame:
    """(label, n, share) of exactly the labels with at least this share of all rows, largest first.

    Every label whose share is above the sketch's error is in the sketch, so the sketch nominates at most `tracked` labels and only
    their rows are counted, in one scan of one column without a shuffle of the other labels.
    """
    if share * tracked < 8:
        raise ValueError(f"{tracked} tracked labels cannot tell those with a share of {share}; track {round(8 / share)}")
    merged = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(frequent, {tracked})").alias("frequent"), F.sum("n").alias("total"))
    nominated = merged.select(F.explode(F.expr(f"approx_top_k_estimate(frequent, {tracked})")).alias("f"), "total").select("f.item", "total")
    counted = df.select(col(label).cast("string").alias("label")).join(F.broadcast(nominated), F.col("label") == F.col("item"))
    counts = counted.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    return counts.withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= share).drop("total").orderBy(F.desc("n"), "label")
