"""Sampling, splitting and balancing.

Each operator has a native form (Spark's own sampler, which depends on how the rows are
partitioned) and a keyed form (a draw from the row's key, the same on every run and layout).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.draws import DRAW_RANGE, below, key_draw
from flowsieve.functions.values import col
from flowsieve.operators.profile import class_counts

SAMPLE_SEED = 42
DRAW = "__draw"
DRAW_BUCKETS = 1 << 16


def sample(df: DataFrame, fraction: float, seed: int = SAMPLE_SEED) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def sample_keyed(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = SAMPLE_SEED) -> DataFrame:
    return df.filter(below(key_draw(keys, seed), fraction))


def lowest_draws(drawn: DataFrame, cap: int, ties: Sequence[Column] = ()) -> DataFrame:
    """The `cap` rows with the lowest values of the column DRAW (a whole number in [0, 2^32)), or all if there are fewer.

    A count per range of draws finds the range in which the cap falls, and a count inside that range finds the
    draw. All rows below that draw are kept by a filter; only rows with exactly that draw are ranked.
    """
    low, width = 0, DRAW_RANGE
    left = cap
    while width > 1:
        width //= DRAW_BUCKETS
        inside = drawn.filter(F.col(DRAW).between(low, low + width * DRAW_BUCKETS - 1))
        bucket = F.floor((F.col(DRAW) - low) / F.lit(width)).cast("int").alias("bucket")
        counts = inside.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # at most DRAW_BUCKETS rows
        at = counts.withColumn("upto", upto).filter(F.col("upto") > left).orderBy("bucket").first()
        if at is None:
            return drawn if low == 0 else drawn.filter(F.col(DRAW) < low + width * DRAW_BUCKETS)
        left -= at["upto"] - at["n"]
        low += at["bucket"] * width
    tied = drawn.filter(F.col(DRAW) == low)
    return drawn.filter(F.col(DRAW) < low).unionByName((tied.orderBy(*ties) if ties else tied).limit(left))


def sample_capped(df: DataFrame, fraction: float, cap: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """A sample of at most `cap` rows: those with the lowest of Spark's random numbers among the sampled ones.

    So every row has the same chance, wherever it stands. The numbers follow the row's place in its partition:
    the table is read more than once, and should be one that reads alike each time, such as stored files.
    """
    drawn = df.withColumn(DRAW, F.floor(F.rand(seed) * F.lit(float(DRAW_RANGE))).cast("bigint"))
    return lowest_draws(drawn.filter(below(F.col(DRAW), fraction)), cap).drop(DRAW)


def sample_capped_keyed(df: DataFrame, fraction: float, cap: int, keys: Sequence[str], seed: int = SAMPLE_SEED) -> DataFrame:
    """The `cap` rows with the lowest draws among the sampled ones, ties by key: the same rows, in this order, on every run."""
    drawn = df.withColumn(DRAW, key_draw(keys, seed)).filter(below(F.col(DRAW), fraction))
    order = [col(k) for k in keys]
    return lowest_draws(drawn, cap, order).orderBy(DRAW, *order).drop(DRAW)


def head_sample(df: DataFrame, rows: int, order: Sequence[str] = ()) -> DataFrame:
    """The first rows as they come, or by a total order if the result must repeat.

    For a look at a few rows: the order shows one end of the data, so statistics use the samples above.
    """
    return (df.orderBy(*[col(c) for c in order]) if order else df).limit(rows)


def split(df: DataFrame, shares: Sequence[float] = N.FOREST_SPLIT, seed: int = N.FOREST_SEED) -> list[DataFrame]:
    """Spark's own split; it sorts the rows of every partition, once per part, to be repeatable."""
    return df.randomSplit(list(shares), seed=seed)


def split_keyed(df: DataFrame, keys: Sequence[str], shares: Sequence[float] = N.FOREST_SPLIT, seed: int = N.FOREST_SEED) -> list[DataFrame]:
    """Disjoint parts that together hold every row; each part is a plain filter, nothing is sorted."""
    drawn = df.withColumn(DRAW, key_draw(keys, seed))
    return [drawn.filter(of_part(F.col(DRAW), shares, i)).drop(DRAW) for i in range(len(shares))]


def of_part(draw: Column, shares: Sequence[float], part: int) -> Column:
    """True for the draws of one part of a split; no draw is below the first part or above the last, so neither is compared."""
    total = float(sum(shares))
    ends = [0.0]
    for share in shares:
        ends.append(ends[-1] + share / total)
    bounds = ([~below(draw, ends[part])] if part > 0 else []) + ([below(draw, ends[part + 1])] if part < len(shares) - 1 else [])
    return reduce(Column.__and__, bounds, F.lit(True))


def in_part(keys: Sequence[str], shares: Sequence[float], seed: int, part: int) -> Column:
    """True for rows that the keyed split puts into this part."""
    return of_part(key_draw(keys, seed), shares, part)


def balance_fraction(rows: Column, label: Column, majority: str, target: int) -> Column:
    """What to keep of a class: the majority down to the target and never above all of it."""
    return F.when(label == majority, F.least(F.lit(1.0), F.lit(float(target)) / rows)).otherwise(F.lit(1.0))


def balance_fractions(df: DataFrame, label: str = N.LABEL, majority: str = N.MAJORITY, target: int = N.BALANCE_TARGET) -> DataFrame:
    """(label, n, fraction) for every class; null labels are in none."""
    counts = class_counts(df.filter(col(label).isNotNull()), label)
    return counts.withColumn("fraction", balance_fraction(F.col("n"), col(label), majority, target))


def balance(df: DataFrame, label: str = N.LABEL, majority: str = N.MAJORITY, target: int = N.BALANCE_TARGET, seed: int = SAMPLE_SEED) -> DataFrame:
    """Native stratified sample by the balance fractions (one number per class on the driver)."""
    fractions = {r[label]: r["fraction"] for r in balance_fractions(df, label, majority, target).collect()}
    return df.stat.sampleBy(col(label), fractions, seed)


def balance_keyed(
    df: DataFrame,
    keys: Sequence[str],
    label: str = N.LABEL,
    majority: str = N.MAJORITY,
    target: int = N.BALANCE_TARGET,
    seed: int = SAMPLE_SEED,
) -> DataFrame:
    """Keyed stratified sample. The one number it needs, the size of the majority class, is a
    scalar subquery of the same plan, so nothing passes through the driver."""
    majority_rows = df.filter(col(label) == majority).agg(F.count(F.lit(1)).alias("n")).scalar()
    fraction = F.least(F.lit(1.0), F.try_divide(F.lit(float(target)), majority_rows))
    kept = (col(label) != majority) | below(key_draw(keys, seed), fraction)
    return df.filter(col(label).isNotNull() & kept)


def draw_histogram(drawn: DataFrame, label: str, low_bits: int, wanted: DataFrame | None = None) -> DataFrame:
    """(label, bucket, n): rows of each class by the 16 bits of their draw above `low_bits`; with `wanted`, only those in its bucket of their class."""
    bucket = F.shiftright(F.col(DRAW), low_bits).bitwiseAND(DRAW_BUCKETS - 1)
    rows = drawn if wanted is None else drawn.join(F.broadcast(wanted), label).filter(F.shiftright(F.col(DRAW), low_bits + 16) == F.col("bucket")).drop("bucket")
    return rows.groupBy(col(label).alias(label), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def cut_buckets(histogram: DataFrame, label: str, targets: dict) -> dict:
    """For each class with more rows than its target: the bucket in which the target falls, and how many of its rows are still wanted."""
    upto = F.sum("n").over(Window.partitionBy(label).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # at most DRAW_BUCKETS rows a class
    target = F.coalesce(*[F.when(col(label) == F.lit(name), F.lit(rows)) for name, rows in targets.items()])
    over = histogram.withColumn("upto", upto).withColumn("target", target).filter("upto > target")
    first = over.groupBy(col(label).alias(label)).agg(F.min_by(F.struct("bucket", (F.col("target") - F.col("upto") + F.col("n")).alias("left")), "bucket").alias("cut"))
    return {r[label]: (r["cut"]["bucket"], r["cut"]["left"]) for r in first.collect()}


def balance_exact(
    df: DataFrame, keys: Sequence[str], label: str = N.LABEL, targets: dict | None = None, seed: int = SAMPLE_SEED
) -> DataFrame:
    """Each class cut to exactly its target, or whole if it has no more rows; by default only the majority class has one.

    The rows of a class that stay are those with its lowest draws. Two histograms of draws, of all classes at once, find the last
    draw of each class: three scans for any number of rows and classes with targets. Rows below their class's cut pass a plain filter;
    only rows with exactly the cut draw are ranked, by key and content. Null labels are in no class.
    """
    targets = {N.MAJORITY: N.BALANCE_TARGET} if targets is None else targets
    labelled = df.filter(col(label).isNotNull())
    if not targets:
        return labelled
    drawn = labelled.withColumn(DRAW, key_draw(keys, seed))
    named = drawn.filter(col(label).isin(list(targets))).select(col(label).alias(label), DRAW)
    coarse = cut_buckets(draw_histogram(named, label, 16), label, targets)
    if not coarse:
        return labelled
    spark, kind = df.sparkSession, df.schema[label].dataType.simpleString()
    wanted = spark.createDataFrame([(name, bucket) for name, (bucket, _) in coarse.items()], f"`{label}` {kind}, bucket bigint")
    fine = cut_buckets(draw_histogram(named, label, 0, wanted), label, {name: left for name, (_, left) in coarse.items()})
    # Without a finer cut the whole bucket is wanted.
    cuts = {name: ((bucket << 16) + fine[name][0], fine[name][1]) if name in fine else ((bucket + 1) << 16, 0) for name, (bucket, _) in coarse.items()}
    cut = F.coalesce(*[F.when(col(label) == F.lit(name), F.lit(at)) for name, (at, _) in cuts.items()], F.lit(DRAW_RANGE))
    left = F.coalesce(*[F.when(col(label) == F.lit(name), F.lit(n)) for name, (_, n) in cuts.items()])
    content = F.xxhash64(*[col(c) for c in df.columns])
    place = F.row_number().over(Window.partitionBy(col(label)).orderBy(*[col(k) for k in keys], content))
    tied = drawn.filter(F.col(DRAW) == cut).withColumn("__place", place).filter(F.col("__place") <= left).drop("__place")
    return drawn.filter(F.col(DRAW) < cut).unionByName(tied).drop(DRAW)
