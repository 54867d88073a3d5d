"""Class-wise quantiles, box statistics, histograms and densities over finite values."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.tables import fact_table
from flowsieve.functions.values import INFINITY, col, finite

GROUP, VARIABLE, VALUE = "class", "variable", "value"
QUARTILES = (0.25, 0.5, 0.75)

# Rows of one bracket that may be ranked in a single window; above it the bracket is narrowed first.
BRACKET_ROWS = 1_000_000
GRID_STEPS, SKETCH_ACCURACY = 1000, 10_000
# Grid points left around a wanted rank.
GRID_MARGIN = 2


def long_values(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """(class, variable, value) for the finite values of the variables the table has."""
    present = [v for v in variables if v in df.columns]
    narrow = df.select(col(group).cast("string").alias(GROUP), *[col(v).cast("double").alias(v) for v in present])
    return narrow.unpivot(GROUP, [col(v) for v in present], VARIABLE, VALUE).filter(finite(VALUE))


@dataclass
class Bracket:
    """Where one quantile of one class and variable must lie: `rows` values in [low, high]."""

    group: str
    variable: str
    share: float
    total: int
    rows: int
    low: float = -INFINITY
    high: float = INFINITY

    @property
    def key(self) -> tuple:
        return (self.group, self.variable, self.share)

    @property
    def position(self) -> float:
        return self.share * (self.total - 1)

    def narrowed(self, grid: Sequence[float], below: int, rows: int, margin: int) -> Bracket:
        """The bracket cut to the sketch's grid points around its ranks."""
        first, last = math.floor(self.position) - below, math.ceil(self.position) - below
        start = math.floor(first / rows * GRID_STEPS) - margin
        end = math.ceil((last + 1) / rows * GRID_STEPS) + margin
        low = grid[start] if start > 0 else self.low
        high = grid[end] if end < GRID_STEPS else self.high
        kept = math.ceil(rows * (end - start) / GRID_STEPS)
        return Bracket(self.group, self.variable, self.share, self.total, kept, low, high)


def bracket_table(values: DataFrame, brackets: Sequence[Bracket]) -> DataFrame:
    rows = [(*b.key, float(b.low), float(b.high)) for b in brackets]
    schema = {GROUP: "string", VARIABLE: "string", "share": "double", "low": "double", "high": "double"}
    return fact_table(values.sparkSession, rows, schema)


def within(values: DataFrame, brackets: Sequence[Bracket]) -> DataFrame:
    """Values up to each bracket's upper end; those below its lower end carry a null value."""
    table = bracket_table(values, brackets)
    same = F.col("v.class").eqNullSafe(F.col("b.class")) & (F.col("v.variable") == F.col("b.variable"))
    joined = values.alias("v").join(table.alias("b"), same).filter(F.col("value") <= F.col("high"))
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    return joined.select("b.class", "b.variable", "share", inside.alias(VALUE))


def sketch() -> list[Column]:
    """Counts and a bounded sketch (values at a fixed grid of shares) of the values of a group."""
    grid = F.array(*[F.lit(k / GRID_STEPS) for k in range(GRID_STEPS + 1)])
    return [
        F.count_if(F.col(VALUE).isNull()).alias("below"),
        F.count(VALUE).alias("rows"),
        F.percentile_approx(VALUE, grid, SKETCH_ACCURACY).alias("grid"),
    ]


def whole_brackets(values: DataFrame, shares: Sequence[float], margin: int = GRID_MARGIN) -> tuple[list[Bracket], dict]:
    """One scan for the size and the sketch of every class and variable: brackets around the shares, and the sketches."""
    sketches = {(r[GROUP], r[VARIABLE]): r for r in values.groupBy(GROUP, VARIABLE).agg(*sketch()).collect()}
    whole = [Bracket(*key, q, r["rows"], r["rows"]) for key, r in sketches.items() for q in shares]
    return [b.narrowed(sketches[b.key[:2]]["grid"], 0, b.total, margin) for b in whole], sketches


def narrow(values: DataFrame, brackets: Sequence[Bracket], margin: int) -> list[Bracket]:
    """Cut brackets by a sketch of the values inside them, one scan for all."""
    sketches = within(values, brackets).groupBy(GROUP, VARIABLE, "share").agg(*sketch())
    found = {(r[GROUP], r[VARIABLE], r["share"]): r for r in sketches.collect()}
    return [b.narrowed(found[b.key]["grid"], found[b.key]["below"], found[b.key]["rows"], margin) for b in brackets]


def narrow_large(values: DataFrame, brackets: list[Bracket], bracket_rows: int, margin: int) -> list[Bracket]:
    """Narrow every bracket of many rows again and again, for as long as that helps."""
    while large := [b for b in brackets if b.rows > bracket_rows and b.low < b.high]:
        cut = {b.key: b for b in narrow(values, large, margin)}
        if all(cut[b.key].rows >= b.rows for b in large):
            break
        brackets = [cut.get(b.key, b) for b in brackets]
    return brackets


def ranked_values(values: DataFrame, brackets: Sequence[Bracket]) -> dict[tuple, float]:
    """The exact quantile of each bracket, by counting its distinct values in order.

    Equal values are counted together before the shuffle, so a hot value is one row. A bracket that
    does not hold its ranks is left out of the answer.
    """
    counts = within(values, brackets).groupBy(GROUP, VARIABLE, "share", VALUE).agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy(GROUP, VARIABLE, "share").orderBy(F.asc_nulls_first(VALUE))
    upto = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto)
    ranks = [(*b.key, math.floor(b.position), math.ceil(b.position)) for b in brackets]
    schema = {GROUP: "string", VARIABLE: "string", "share": "double", "first": "bigint", "last": "bigint"}
    table = fact_table(values.sparkSession, ranks, schema)
    same = (
        F.col("r.class").eqNullSafe(F.col("t.class"))
        & (F.col("r.variable") == F.col("t.variable"))
        & (F.col("r.share") == F.col("t.share"))
    )
    start = F.col("upto") - F.col("n")
    holds_first = (start <= F.col("first")) & (F.col("first") < F.col("upto"))
    holds_last = (start <= F.col("last")) & (F.col("last") < F.col("upto"))
    picked = (
        ranked.alias("r")
        .join(table.alias("t"), same)
        .filter((holds_first | holds_last) & F.col(VALUE).isNotNull())
        .groupBy("t.class", "t.variable", "t.share")
        .agg(
            F.max(F.when(holds_first, F.col(VALUE))).alias("low"),
            F.max(F.when(holds_last, F.col(VALUE))).alias("high"),
        )
    )
    position = {b.key: b.position for b in brackets}
    answer = {}
    for row in picked.collect():
        key = (row["class"], row["variable"], row["share"])
        if row["low"] is not None and row["high"] is not None:
            part = position[key] - math.floor(position[key])
            answer[key] = row["low"] + (row["high"] - row["low"]) * part
    return answer


def cell_counts(values: DataFrame, brackets: Sequence[Bracket], grids: dict[tuple, list[float]]) -> dict[tuple, np.ndarray]:
    """Exact numbers of values in the cells of each bracket's grid, in one scan: cell 2i is below grid point i, cell 2i + 1 is the point itself.

    The grids have a bounded number of points for each wanted quantile; a task sends one row a bracket.
    """
    points: dict[tuple, list] = {}
    for number, b in enumerate(brackets):
        points.setdefault(b.key[:2], []).append((number, np.array(grids[b.key])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.to_pandas()
            for key, part in rows.groupby([GROUP, VARIABLE], dropna=False)[VALUE]:
                name = (None if pd.isna(key[0]) else key[0], key[1])
                for number, grid in points.get(name, ()):
                    x = part.to_numpy()
                    left = np.searchsorted(grid, x, "left")
                    cell = 2 * left + (np.searchsorted(grid, x, "right") > left)
                    totals[number] = totals.get(number, 0) + np.bincount(cell, minlength=2 * len(grid) + 1)
        found = [(number, cell, int(n)) for number, cells in totals.items() for cell, n in enumerate(cells) if n]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3, names=["number", "cell", "n"])

    counted = values.select(GROUP, VARIABLE, VALUE).mapInArrow(count, "number bigint, cell bigint, n bigint").groupBy("number", "cell").agg(F.sum("n").alias("n"))
    cells = {b.key: np.zeros(2 * len(grids[b.key]) + 1, dtype=np.int64) for b in brackets}
    for row in counted.collect():
        cells[brackets[row["number"]].key][row["cell"]] = row["n"]
    return cells


def cells_of_ranks(b: Bracket, grid: Sequence[float], counts: np.ndarray) -> Bracket:
    """The bracket cut to the cells that hold its ranks; their counts are exact, so it holds them."""
    upto = np.cumsum(counts)
    first, last = (int(np.searchsorted(upto, rank, "right")) for rank in (math.floor(b.position), math.ceil(b.position)))
    low = grid[first // 2] if first % 2 else math.nextafter(grid[first // 2 - 1], math.inf) if first else -INFINITY
    high = grid[last // 2] if last % 2 else math.nextafter(grid[last // 2], -math.inf) if last // 2 < len(grid) else INFINITY
    return Bracket(b.group, b.variable, b.share, b.total, int(counts[first : last + 1].sum()), max(b.low, low), min(b.high, high))


def surely_narrowed(values: DataFrame, brackets: list[Bracket], bracket_rows: int) -> list[Bracket]:
    """Brackets that hold their ranks for certain, cut by exact counts until their rows are few or their values equal.

    The cells are those of a sketch of the bracket and of the middle of its range, so that a bracket is at least halved even
    where the sketch tells nothing.
    """
    while large := [b for b in brackets if b.rows > bracket_rows and b.low < b.high]:
        sketches = within(values, large).filter(F.col(VALUE).isNotNull()).groupBy(GROUP, VARIABLE, "share").agg(*sketch())
        found = {(r[GROUP], r[VARIABLE], r["share"]): r["grid"] for r in sketches.collect()}
        grids = {key: sorted({*grid, grid[0] / 2 + grid[-1] / 2}) for key, grid in found.items()}
        counts = cell_counts(values, large, grids)
        cut = {b.key: cells_of_ranks(b, grids[b.key], counts[b.key]) for b in large}
        brackets = [cut.get(b.key, b) for b in brackets]
    return brackets


def exact_quantiles(
    values: DataFrame, shares: Sequence[float] = QUARTILES, bracket_rows: int = BRACKET_ROWS
) -> dict[tuple, float]:
    """Exact interpolated quantiles per class and variable, as {(class, variable, share): value}.

    For few classes (their names reach the driver, as in label indexing). A bounded sketch brackets
    each wanted rank; only the values inside a bracket are counted and put in order. A bracket that
    still holds many rows is narrowed again, so memory per task stays bounded. Ranks that a bracket turns out not
    to hold, and brackets that do not shrink, are looked for again by exact counts, which cannot miss them.
    """
    brackets, _ = whole_brackets(values, shares)
    small = [b for b in narrow_large(values, brackets, bracket_rows, GRID_MARGIN) if b.rows <= bracket_rows or b.low == b.high]
    answer = ranked_values(values, small) if small else {}
    missed = [Bracket(*b.key, b.total, b.total) for b in brackets if b.key not in answer]
    return answer | ranked_values(values, surely_narrowed(values, missed, bracket_rows)) if missed else answer


def box_statistics(df: DataFrame, group: str = N.BINARY_COLUMN, variables: Sequence[str] = tuple(N.BOX_COLUMNS)) -> DataFrame:
    """Quartiles, whiskers and outliers per class and variable; absent variables are skipped.

    A whisker is the furthest value within 1.5 interquartile ranges of the box, never inside it.
    """
    values = long_values(df, group, variables)
    quantiles = exact_quantiles(values)
    boxes = sorted({key[:2] for key in quantiles}, key=str)
    rows = [(*box, *[quantiles[(*box, q)] for q in QUARTILES]) for box in boxes]
    schema = {GROUP: "string", VARIABLE: "string", "q1": "double", "median": "double", "q3": "double"}
    table = fact_table(values.sparkSession, rows, schema)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(VALUE) >= F.col("q1") - reach) & (F.col(VALUE) <= F.col("q3") + reach)
    same = F.col("v.class").eqNullSafe(F.col("b.class")) & (F.col("v.variable") == F.col("b.variable"))
    joined = values.alias("v").join(table.alias("b"), same).select("b.*", VALUE)
    return joined.groupBy(GROUP, VARIABLE, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.least(F.min(F.when(inside, F.col(VALUE))), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, F.col(VALUE))), F.col("q3")).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def class_moments(values: DataFrame) -> DataFrame:
    return values.groupBy(GROUP, VARIABLE).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(VALUE).alias("low"),
        F.max(VALUE).alias("high"),
        F.stddev_samp(VALUE).alias("deviation"),
    )


def moment_table(values: DataFrame) -> DataFrame:
    """The moments, fitted once and joined to the values as a small table."""
    moments = class_moments(values)
    rows = [tuple(r) for r in moments.collect()]
    kinds = ("string", "string", "bigint", "double", "double", "double")
    return fact_table(values.sparkSession, rows, dict(zip(moments.columns, kinds)))


def with_moments(values: DataFrame, moments: DataFrame) -> DataFrame:
    same = F.col("v.class").eqNullSafe(F.col("m.class")) & (F.col("v.variable") == F.col("m.variable"))
    return values.alias("v").join(moments.alias("m"), same).select("m.*", VALUE)


def histogram(df: DataFrame, group: str = N.BINARY_COLUMN, variables: Sequence[str] = tuple(N.DENSITY_COLUMNS), bins: int = 50) -> DataFrame:
    """Equal bins over each class's own range, with counts, share of the class and density."""
    values = long_values(df, group, variables)
    placed = with_moments(values, moment_table(values)).withColumn(
        "bin",
        F.when(F.col("high") > F.col("low"), F.least(F.width_bucket(VALUE, F.col("low"), F.col("high"), F.lit(bins)), F.lit(bins)))
        .otherwise(F.lit(1))
        .cast("int"),
    )
    counts = placed.groupBy(GROUP, VARIABLE, "n", "low", "high", "bin").agg(F.count(F.lit(1)).alias("rows"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    share = F.col("rows") / F.col("n")
    return counts.select(
        GROUP,
        VARIABLE,
        "bin",
        (F.col("low") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("low") + F.col("bin") * width).alias("upper"),
        "rows",
        share.alias("share"),
        F.try_divide(share, width).alias("density"),
    )


# Grid of the density curve: 200 points, reaching three bandwidths beyond the data.
DENSITY_POINTS, DENSITY_CUT = 200, 3.0
# Values are first summed into bins of a sixteenth of the bandwidth, each kept at its mean value.
BINS_PER_BANDWIDTH, KERNEL_REACH = 16, 9.0


def density(df: DataFrame, group: str = N.BINARY_COLUMN, variables: Sequence[str] = tuple(N.DENSITY_COLUMNS)) -> DataFrame:
    """Gaussian density of each variable per class, each class normalised by itself.

    The bandwidth is the class deviation times n^(-1/5). Bins, not rows, meet the grid, and a bin
    only the grid points its kernel reaches. Classes with no spread have no curve.
    """
    values = long_values(df, group, variables)
    moments = moment_table(values).filter("deviation > 0").select(
        "*", (F.col("deviation") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth")
    )
    bins = (
        with_moments(values, moments)
        .withColumn("bin", F.floor((F.col(VALUE) - F.col("low")) * BINS_PER_BANDWIDTH / F.col("bandwidth")))
        .groupBy(GROUP, VARIABLE, "n", "low", "high", "bandwidth", "bin")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg(VALUE).alias("center"))
    )
    start = F.col("low") - F.lit(DENSITY_CUT) * F.col("bandwidth")
    step = (F.col("high") + F.lit(DENSITY_CUT) * F.col("bandwidth") - start) / F.lit(float(DENSITY_POINTS - 1))

    def point_at(offset: Column, rounding) -> Column:
        at = rounding((F.col("center") + offset - F.col("start")) / F.col("step"))
        return F.greatest(F.lit(0), F.least(F.lit(DENSITY_POINTS - 1), at)).cast("int")

    reach = F.col("bandwidth") * F.lit(KERNEL_REACH)
    points = (
        bins.withColumn("start", start)
        .withColumn("step", step)
        .withColumn("point", F.explode(F.sequence(point_at(-reach, F.floor), point_at(reach, F.ceil))))
        .withColumn("x", F.col("start") + F.col("point") * F.col("step"))
    )
    distance = (F.col("x") - F.col("center")) / F.col("bandwidth")
    kernel = F.col("rows") * F.exp(F.lit(-0.5) * distance * distance)
    scale = F.col("n") * F.col("bandwidth") * F.lit(math.sqrt(2 * math.pi))
    return points.groupBy(GROUP, VARIABLE, "point", "x", "n", "bandwidth").agg(F.sum(kernel).alias("mass")).select(
        GROUP, VARIABLE, "point", "x", (F.col("mass") / scale).alias("density")
    )
