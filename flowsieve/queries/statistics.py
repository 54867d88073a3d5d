"""Correlation, redundancy, box statistics, histograms and densities over whole tables."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.tables import local_table
from flowsieve.operators import clean, correlation, distribution, sketches
from flowsieve.queries.profiles import LINE_FEATURES
from flowsieve.queries.registry import query, round_columns, sql_name, sql_round, sql_text, table
from flowsieve.queries.standin import KEY, WITH_FLOWS, flows
from flowsieve.sources.workspace import scratch_path

# Features of lineitem with nulls, NaN and a constant, for the pairwise rules.
GAPS = {
    "quantity": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END",
    "price": "CASE WHEN l_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END",
    "net": "l_extendedprice * (1 - l_discount)",
    "gross": "l_extendedprice * (1 + l_tax)",
    "same": "CAST(3 AS DOUBLE)",
    "unbounded": "CASE WHEN l_orderkey % 5003 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE l_tax END",
}


def pairs_sql(columns: list[str], source: str) -> str:
    """Pairwise correlation of all pairs, from one row per record and column joined to itself."""
    values = ", ".join(f"CAST({sql_name(c)} AS DOUBLE)" for c in columns)
    names = ", ".join(sql_text(c) for c in columns)
    return (
        f"WITH cells AS (SELECT * FROM (SELECT row_number() OVER () AS id, unnest(range({len(columns)})) AS at, unnest([{values}]) AS v "
        f"FROM {source}) WHERE v IS NOT NULL AND NOT isnan(v)) "
        "SELECT CAST(a.at AS INTEGER) AS position_a, CAST(b.at AS INTEGER) AS position_b, "
        f"[{names}][a.at + 1] AS column_a, [{names}][b.at + 1] AS column_b, "
        "CASE WHEN bool_and(isfinite(a.v) AND isfinite(b.v)) AND min(a.v) < max(a.v) AND min(b.v) < max(b.v) "
        "THEN corr(a.v, b.v) FILTER (WHERE isfinite(a.v) AND isfinite(b.v)) END AS r "
        "FROM cells a JOIN cells b ON a.id = b.id AND a.at < b.at GROUP BY a.at, b.at"
    )


ROUNDED_PAIR = "position_a, position_b, column_a, column_b, " + sql_round("r") + " AS r"
WITH_GAPS = "WITH gaps AS (SELECT " + ", ".join(f"{s} AS {c}" for c, s in GAPS.items()) + " FROM lineitem) "


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[f"{sql} AS {name}" for name, sql in GAPS.items()])


@query("correlation_narrow", f"SELECT {ROUNDED_PAIR} FROM ({pairs_sql(LINE_FEATURES, 'lineitem')})")
def correlation_narrow(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(correlation.correlation(table(spark, sf, "lineitem"), LINE_FEATURES), ["r"])


@query("correlation_gaps", WITH_GAPS + f"SELECT {ROUNDED_PAIR} FROM ({pairs_sql(list(GAPS), 'gaps')})")
def correlation_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(correlation.correlation(gaps(spark, sf), list(GAPS)), ["r"])


@query("correlation_gaps_by_matrix", WITH_GAPS + f"SELECT {ROUNDED_PAIR} FROM ({pairs_sql(list(GAPS), 'gaps')})")
def correlation_gaps_by_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The same moments merged from many more tasks."""
    return round_columns(correlation.correlation(gaps(spark, sf).repartition(37), list(GAPS)), ["r"])


# Columns whose first rows are unlike the rest: another magnitude, or nothing at all.
UNTYPICAL = {
    "late": "CASE WHEN l_orderkey < 100 THEN NULL ELSE CAST(1000000000 + l_linenumber AS DOUBLE) END",
    "low_first": "CASE WHEN l_orderkey < 100 THEN CAST(-1000000000 AS DOUBLE) ELSE CAST(1000000000 + l_linenumber + l_suppkey % 3 AS DOUBLE) END",
    "high_first": "CASE WHEN l_orderkey < 100 THEN CAST(100000000 AS DOUBLE) ELSE CAST(l_linenumber % 7 AS DOUBLE) / 7 END",
    "late_too": "CASE WHEN l_orderkey < 100 THEN NULL ELSE CAST(l_linenumber % 7 AS DOUBLE) / 7 END",
    "one_late": "CASE WHEN l_orderkey < 100 THEN CAST(l_linenumber AS DOUBLE) ELSE CAST(4 AS DOUBLE) END",
}
WITH_UNTYPICAL = "WITH untypical AS (SELECT " + ", ".join(f"{s} AS {c}" for c, s in UNTYPICAL.items()) + " FROM lineitem) "


def untypical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[f"{sql} AS {name}" for name, sql in UNTYPICAL.items()])


@query("correlation_untypical_start", WITH_UNTYPICAL + f"SELECT {ROUNDED_PAIR} FROM ({pairs_sql(list(UNTYPICAL), 'untypical')})")
def correlation_untypical_start(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(correlation.correlation(untypical(spark, sf), list(UNTYPICAL)), ["r"])


NO_PAIRS = " UNION ALL ".join(
    f"SELECT {i} AS position_a, {j} AS position_b, '{a}' AS column_a, '{b}' AS column_b, CAST(NULL AS DOUBLE) AS r" for (i, a), (j, b) in combinations(enumerate(UNTYPICAL), 2)
)


@query("correlation_no_rows", NO_PAIRS)
def correlation_no_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair is there, without a value."""
    none = table(spark, sf, "lineitem").filter("l_orderkey < 0").selectExpr(*[f"{sql} AS {name}" for name, sql in UNTYPICAL.items()])
    return round_columns(correlation.correlation(none, list(UNTYPICAL)), ["r"])


@query("correlation_overflow", "SELECT 0 AS position_a, 1 AS position_b, 'huge' AS column_a, 'l_quantity' AS column_b, CAST(NULL AS DOUBLE) AS r")
def correlation_overflow(spark: SparkSession, sf: str) -> DataFrame:
    """Squares beyond the range of doubles leave no value."""
    df = table(spark, sf, "lineitem").select((F.col("l_quantity") * 1e200).alias("huge"), "l_quantity")
    return round_columns(correlation.correlation(df, ["huge", "l_quantity"]), ["r"])


@query("correlation_wide", WITH_FLOWS + f"SELECT {ROUNDED_PAIR} FROM ({pairs_sql(N.FEATURES, 'flows')})")
def correlation_wide(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(correlation.correlation(flows(spark, sf), N.FEATURES), ["r"])


DIMENSIONS = [f"d{i}" for i in range(64)]
WITH_SPREAD = "WITH spread AS (SELECT " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS d{i}" for i in range(64)) + " FROM embeddings) "


@query("correlation_embeddings", WITH_SPREAD + f"SELECT {ROUNDED_PAIR} FROM ({pairs_sql(DIMENSIONS, 'spread')})")
def correlation_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(64)])
    return round_columns(correlation.correlation(vectors, DIMENSIONS), ["r"])


@query("high_correlation", WITH_FLOWS + f"SELECT {ROUNDED_PAIR} FROM ({pairs_sql(N.FEATURES, 'flows')}) WHERE abs(r) > 0.95")
def high_correlation(spark: SparkSession, sf: str) -> DataFrame:
    pairs = correlation.correlation(flows(spark, sf), N.FEATURES)
    return round_columns(correlation.high_correlation(pairs), ["r"])


WALK = (
    f"high AS MATERIALIZED (SELECT position_a AS i, position_b AS j, column_b FROM ({pairs_sql(N.FEATURES, 'flows')}) WHERE abs(r) > 0.95), "
    "walk AS (SELECT 0 AS step, CAST([] AS INTEGER[]) AS dropped UNION ALL "
    "SELECT w.step + 1, CASE WHEN EXISTS (SELECT 1 FROM high WHERE high.j = w.step + 1 AND NOT list_contains(w.dropped, high.i)) "
    f"THEN list_append(w.dropped, w.step + 1) ELSE w.dropped END FROM walk w WHERE w.step < {len(N.FEATURES) - 1}) "
)


@query(
    "redundant_columns",
    WITH_FLOWS.replace("WITH flows", "WITH RECURSIVE flows").rstrip() + ", " + WALK + "SELECT DISTINCT j AS position, column_b AS \"column\" FROM high "
    f"WHERE j IN (SELECT unnest(dropped) FROM walk WHERE step = {len(N.FEATURES) - 1})",
)
def redundant_columns(spark: SparkSession, sf: str) -> DataFrame:
    dropped = correlation.redundant_columns(correlation.correlation(flows(spark, sf), N.FEATURES))
    rows = [(N.FEATURES.index(c), c) for c in dropped]
    return local_table(spark, rows, {"position": "int", "column": "string"})


BINARY = "CASE WHEN \"Label\" = 'Benign' THEN 'Benigno' ELSE 'Ataque' END AS class"


def long_sql(columns: list[str]) -> str:
    branches = [f"SELECT {BINARY}, {sql_text(c)} AS variable, {sql_name(c)} AS value FROM flows WHERE isfinite({sql_name(c)})" for c in columns]
    return f"long AS ({' UNION ALL '.join(branches)})"


BOX_SQL = (
    WITH_FLOWS.rstrip() + ", " + long_sql(N.BOX_COLUMNS) + ", box AS (SELECT class, variable, quantile_cont(value, 0.25) AS q1, "
    "quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2), "
    "placed AS (SELECT class, variable, q1, median, q3, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside "
    "FROM long JOIN box USING (class, variable)) "
    f"SELECT class, variable, {sql_round('q1', 4)} AS q1, {sql_round('median', 4)} AS median, {sql_round('q3', 4)} AS q3, count(*) AS n, "
    f"{sql_round('least(min(value) FILTER (WHERE inside), q1)', 4)} AS whisker_low, "
    f"{sql_round('greatest(max(value) FILTER (WHERE inside), q3)', 4)} AS whisker_high, "
    "count(*) FILTER (WHERE NOT inside) AS outliers FROM placed GROUP BY class, variable, placed.q1, placed.median, placed.q3"
)


@query("box_statistics", BOX_SQL)
def box_statistics(spark: SparkSession, sf: str) -> DataFrame:
    boxes = distribution.box_statistics(clean.binary_label(flows(spark, sf)))
    return round_columns(boxes, ["q1", "median", "q3", "whisker_low", "whisker_high"], 4)


BINS = 50
MOMENTS = "moments AS (SELECT class, variable, count(*) AS n, min(value) AS low, max(value) AS high, stddev_samp(value) AS deviation FROM long GROUP BY 1, 2)"
HISTOGRAM_SQL = (
    WITH_FLOWS.rstrip() + ", " + long_sql(N.DENSITY_COLUMNS) + ", " + MOMENTS + ", "
    f"placed AS (SELECT class, variable, n, low, high, CAST(CASE WHEN high > low THEN "
    f"least(floor((value - low) / ((high - low) / {BINS})) + 1, {BINS}) ELSE 1 END AS INTEGER) AS bin FROM long JOIN moments USING (class, variable)) "
    f"SELECT class, variable, bin, {sql_round('low + (bin - 1) * ((high - low) / 50.0)', 4)} AS lower, "
    f"{sql_round('low + bin * ((high - low) / 50.0)', 4)} AS upper, count(*) AS rows, {sql_round('count(*) / n')} AS share, "
    f"{sql_round('(count(*) / n) / ((high - low) / 50.0)')} AS density FROM placed GROUP BY class, variable, n, low, high, bin"
)


@query("class_histogram", HISTOGRAM_SQL)
def class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    bars = distribution.histogram(clean.binary_label(flows(spark, sf)), bins=BINS)
    return round_columns(round_columns(bars, ["lower", "upper"], 4), ["share", "density"])


DENSITY_SQL = (
    WITH_FLOWS.rstrip() + ", " + long_sql(N.DENSITY_COLUMNS) + ", " + MOMENTS + ", "
    "wide AS (SELECT *, deviation * pow(n, -0.2) AS h FROM moments WHERE deviation > 0), "
    "bins AS (SELECT class, variable, n, low, high, h, floor((value - low) * 16 / h) AS bin, count(*) AS rows, avg(value) AS center "
    "FROM long JOIN wide USING (class, variable) GROUP BY ALL), "
    "grid AS (SELECT class, variable, CAST(point AS INTEGER) AS point, (low - 3 * h) + point * ((high - low + 6 * h) / 199) AS x "
    "FROM wide, range(200) AS points(point)) "
    f"SELECT class, variable, point, {sql_round('x', 4)} AS x, "
    f"{sql_round('sum(rows * exp(-0.5 * pow((x - center) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))')} AS density "
    "FROM grid JOIN bins USING (class, variable) GROUP BY class, variable, point, x"
)


@query("class_density", DENSITY_SQL)
def class_density(spark: SparkSession, sf: str) -> DataFrame:
    curves = distribution.density(clean.binary_label(flows(spark, sf)))
    return round_columns(round_columns(curves, ["x"], 4), ["density"])


# --- stored sketches

PARTS = 5
PART_SQL = f"CAST(split_part({KEY}, '|', 1) AS BIGINT) % {PARTS}"
SHARES = (0.01, 0.25, 0.5, 0.75, 0.99)


@lru_cache(maxsize=4)
def stored_sketches(spark: SparkSession, sf: str) -> str:
    """Sketches of the box columns for each part of the records, as they would be stored file by file."""
    rows = clean.binary_label(flows(spark, sf)).withColumn("part", F.expr(PART_SQL))
    path = scratch_path(spark, "sketches")
    sketches.quantile_sketches(rows, by="part").write.parquet(path)
    return path


SHARES_SQL = "(SELECT unnest([" + ", ".join(f"CAST({q} AS DOUBLE)" for q in SHARES) + "]) AS share)"


@query("sketched_quantile_ranks", WITH_FLOWS.rstrip() + ", " + long_sql(N.BOX_COLUMNS) + f" SELECT class, variable, share, n, true AS within FROM (SELECT class, variable, count(*) AS n FROM long GROUP BY 1, 2), {SHARES_SQL}")
def sketched_quantile_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the merged sketches, and whether the exact ranks of the answers are within the stated error."""
    asked = sketches.sketched_quantiles(spark.read.parquet(stored_sketches(spark, sf)), SHARES)
    values = distribution.long_values(clean.binary_label(flows(spark, sf)), N.BINARY_COLUMN, N.BOX_COLUMNS)
    met = values.withColumnRenamed("value", "v").join(F.broadcast(asked), ["class", "variable"]).groupBy("class", "variable", "share", "n")
    counted = met.agg(F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    error = sketches.rank_error()
    within = (F.col("below") / F.col("n") <= F.col("share") + error) & (F.col("upto") / F.col("n") >= F.col("share") - error)
    return counted.select("class", "variable", "share", "n", within.alias("within"))


# Many labels, a few of them frequent.
MANY_LABELS = "CASE WHEN l_linenumber <= 2 THEN concat('hot ', l_returnflag) ELSE concat('part ', CAST(l_partkey AS VARCHAR(20))) END"
FREQUENT = 0.04


def many_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(f"{MANY_LABELS} AS label", f"l_orderkey % {PARTS} AS part")


@query(
    "frequent_labels",
    f"WITH labels AS (SELECT {MANY_LABELS} AS label FROM lineitem) SELECT label, count(*) AS n, {sql_round('count(*) / (SELECT count(*) FROM labels)')} AS share "
    f"FROM labels GROUP BY label HAVING count(*) >= {FREQUENT} * (SELECT count(*) FROM labels)",
)
def frequent_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly the labels with 4 rows of 100, nominated by sketches of all parts."""
    rows = many_labels(spark, sf)
    return round_columns(sketches.frequent_labels(rows, sketches.label_sketches(rows, "label", by="part"), FREQUENT, "label"), ["share"])


@query("distinct_labels", f"SELECT count(*) AS n, true AS within FROM (SELECT {MANY_LABELS} AS label FROM lineitem)")
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, and whether the estimate from merged sketches is within its error of the exact number of labels."""
    rows = many_labels(spark, sf)
    exact = rows.select("label").distinct().agg(F.count(F.lit(1))).scalar()
    found = sketches.distinct_labels(sketches.label_sketches(rows, "label", by="part"))
    return found.select("n", (F.abs(F.col("labels") - exact) <= sketches.distinct_error() * exact).alias("within"))
