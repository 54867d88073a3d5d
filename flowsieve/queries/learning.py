"""Label indexing, scaling, metrics, forests and perceptron over whole tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.tables import compile_wide, local_table, read_splits, release_shuffles
from flowsieve.functions.values import col, quoted
from flowsieve.operators import clean, features, metrics, models, sampling
from flowsieve.plans import stored, train
from flowsieve.queries.profiles import LINE_FEATURES
from flowsieve.queries.registry import query, round_columns, sql_name, sql_round, sql_text, table
from flowsieve.queries.samples import DRAW_RANGE, draw_sql
from flowsieve.queries.standin import KEY, LINE_KEY, WITH_FLOWS, expressions, flows
from flowsieve.sources.fitted import save_pipeline
from flowsieve.sources.parquet import write_version
from flowsieve.sources.workspace import scratch_path

INDEX_SQL = (
    'idx AS (SELECT "Label" AS name, CAST(row_number() OVER (ORDER BY count(*) DESC, "Label") - 1 AS DOUBLE) AS label_index '
    'FROM flows GROUP BY "Label")'
)


@query("label_indexing", WITH_FLOWS.rstrip() + f', {INDEX_SQL} SELECT {KEY}, "Label", label_index FROM flows JOIN idx ON name = "Label"')
def label_indexing(spark: SparkSession, sf: str) -> DataFrame:
    return features.index_labels(flows(spark, sf)).select(KEY, N.LABEL, "label_index")


def keyed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return clean.numerics_to_double(table(spark, sf, "lineitem").select(*LINE_KEY[:1], *LINE_FEATURES))


@query("assemble_vector", "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ["l_orderkey", *LINE_FEATURES]) + " FROM lineitem")
def assemble_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Assembled and spread again: the vector holds the features in order."""
    assembled = features.assemble(keyed_lines(spark, sf), LINE_FEATURES)
    return features.vector_columns(assembled, features.RAW_VECTOR, LINE_FEATURES).select("l_orderkey", *LINE_FEATURES)


def scaled_sql(expression: str) -> str:
    columns = ", ".join(sql_round(expression.format(c=c), 4) + f" AS {c}" for c in LINE_FEATURES)
    return f"SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, {columns} FROM lineitem"


def scaled(spark: SparkSession, sf: str, center: bool) -> DataFrame:
    table_scaled = features.scale(keyed_lines(spark, sf), LINE_FEATURES, center)
    spread = features.vector_columns(table_scaled, features.VECTOR, LINE_FEATURES)
    return round_columns(spread.select("l_orderkey", *LINE_FEATURES), LINE_FEATURES, 4)


@query("scale_by_deviation", scaled_sql("{c} / (stddev_samp({c}) OVER ())"))
def scale_by_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return scaled(spark, sf, center=False)


@query("standardise", scaled_sql("({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER ())"))
def standardise(spark: SparkSession, sf: str) -> DataFrame:
    return scaled(spark, sf, center=True)


# Predictions by a fixed rule, so that both engines score the same rows: class 3 is never a label,
# class 2 is never predicted.
RULE_LABEL = "CASE l_returnflag WHEN 'R' THEN 0.0D WHEN 'A' THEN 1.0D ELSE 2.0D END"
RULE_PREDICTION = "CASE WHEN l_quantity > 45 THEN 3.0D WHEN l_quantity > 20 THEN 0.0D ELSE 1.0D END"
RULE_SQL = f"rule AS (SELECT {RULE_LABEL} AS label, {RULE_PREDICTION} AS prediction FROM lineitem)".replace("0D", "0::DOUBLE")
CONFUSION_SQL = "SELECT label, prediction, count(*) AS n FROM rule GROUP BY 1, 2"


def rule_scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(f"{RULE_LABEL} AS label", f"{RULE_PREDICTION} AS prediction")


@query("confusion_counts", f"WITH {RULE_SQL} {CONFUSION_SQL}")
def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_counts(rule_scored(spark, sf), "label")


METRICS = ["accuracy", "weighted_precision", "weighted_recall", "f1"]
METRICS_SQL = f"""WITH {RULE_SQL},
classes AS (SELECT DISTINCT label FROM rule),
scores AS (SELECT label,
  (SELECT count(*) FROM rule r WHERE r.label = c.label) AS actual,
  (SELECT count(*) FROM rule r WHERE r.prediction = c.label) AS predicted,
  (SELECT count(*) FROM rule r WHERE r.label = c.label AND r.prediction = c.label) AS hits
  FROM classes c),
parts AS (SELECT actual, hits, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p, hits / actual AS r FROM scores)
SELECT {sql_round('sum(hits) / sum(actual)')} AS accuracy,
  {sql_round('sum(actual * p) / sum(actual)')} AS weighted_precision,
  {sql_round('sum(actual * r) / sum(actual)')} AS weighted_recall,
  {sql_round('sum(CASE WHEN p + r = 0 THEN 0 ELSE actual * 2 * p * r / (p + r) END) / sum(actual)')} AS f1
FROM parts"""


@query("metrics", METRICS_SQL)
def rule_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.evaluate(rule_scored(spark, sf), "label"), METRICS)


# --- forests and perceptron

# The records with a whole-number key, a label index (which must not be a feature), and a label that a feature of seven values decides.
DECIDED_BY = "Down/Up Ratio"
NUMBER_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
DECIDED_FROM = [*NUMBER_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DECIDED_ROWS = 1_000_000  # of a file, about
FIT_SPLIT = 32 << 20  # bytes: a file of narrow rows, so that a fit keeps a partition for each
DECIDED_LABEL = "CASE WHEN l_linenumber <= 2 THEN 'Benign' WHEN l_linenumber <= 4 THEN 'Flood' ELSE 'Probe' END"


def decided_list(engine: str) -> list[str]:
    name = quoted if engine == "spark" else sql_name
    values = {**expressions(), DECIDED_BY: "CAST(l_linenumber AS DOUBLE)"}
    features_listed = [f"{sql} AS {name(c)}" for c, sql in values.items()]
    return [*NUMBER_KEY, f"{DECIDED_LABEL} AS {name(N.LABEL)}", f"CAST(l_linenumber AS DOUBLE) AS {name('Label_Index')}", *features_listed]


def decided_columns(engine: str) -> str:
    return ", ".join(decided_list(engine))


def decided(spark: SparkSession, sf: str) -> DataFrame:
    """Worked out while the laid out rows are read: by key, in files that follow from the rows, each in order, as a forest's draws follow the layout."""
    compile_wide(spark)
    lines = spark.read.parquet(decided_path(spark, sf))
    return lines.selectExpr(*decided_list("spark"))


@lru_cache(maxsize=4)
def decided_path(spark: SparkSession, sf: str) -> str:
    """The few columns that the records come from; labels and features are not stored."""
    lines = table(spark, sf, "lineitem").select(*DECIDED_FROM)
    files = max(16, -(-lines.count() // DECIDED_ROWS))
    laid_out = lines.repartition(files, *NUMBER_KEY).sortWithinPartitions(*NUMBER_KEY)
    return write_version(laid_out, scratch_path(spark, "decided"), "rows")


TRAINERS = {
    "large": lambda df: train.train_forest_large(df, keys=NUMBER_KEY),
    "light": lambda df: train.train_forest_light(df, keys=NUMBER_KEY),
    "perceptron": lambda df: train.train_perceptron(df, named=N.FEATURES, keys=NUMBER_KEY),
}


@lru_cache(maxsize=12)
def trained(spark: SparkSession, sf: str, kind: str) -> train.Trained:
    """Each trainer at its full settings, fitted once per session and scale."""
    rows = decided(spark, sf)
    with read_splits(spark, FIT_SPLIT), release_shuffles(spark):
        return TRAINERS[kind](rows)


def held_out_sql(share: float, seed: int) -> str:
    return f"{draw_sql(NUMBER_KEY, seed)} >= {share} * {DRAW_RANGE}"


WITH_DECIDED = f"WITH decided AS (SELECT {decided_columns('duckdb')} FROM lineitem) "
FINITE = " AND ".join(f"isfinite({sql_name(c)})" for c in N.FEATURES)
HELD_OUT = {
    "large": held_out_sql(0.7, N.FOREST_SEED),
    "light": f"{held_out_sql(0.7, N.FOREST_SEED)} AND {FINITE}",
    "perceptron": f"{held_out_sql(0.8, N.PERCEPTRON_SEED)} AND {FINITE}",
}
USED = {"large": N.FEATURES, "light": [c for c in N.FEATURES if c not in N.REDUNDANT], "perceptron": N.FEATURES}


def agreed(scored: DataFrame) -> DataFrame:
    """The metrics, rounded, and whether Spark's evaluator gives the same ones; the rows are scored once."""
    names = {"accuracy": "accuracy", "weighted_precision": "weightedPrecision", "weighted_recall": "weightedRecall", "f1": "f1"}
    with metrics.cached_projection(scored, [features.LABEL_INDEX, "prediction"]) as kept:
        row = metrics.evaluate(kept).first().asDict()
        theirs = {k: MulticlassClassificationEvaluator(labelCol=features.LABEL_INDEX, metricName=v).evaluate(kept) for k, v in names.items()}
    same = all(abs(row[k] - theirs[k]) < 1e-12 for k in names)
    table_ = local_table(scored.sparkSession, [tuple(row[m] for m in METRICS)], {m: "double" for m in METRICS})
    return round_columns(table_, METRICS).withColumn("as_evaluator", F.lit(same))


ALL_RIGHT = "SELECT CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS weighted_precision, CAST(1 AS DOUBLE) AS weighted_recall, CAST(1 AS DOUBLE) AS f1, true AS as_evaluator"


def metrics_query(kind: str, name: str) -> None:
    query(name, ALL_RIGHT)(lambda spark, sf: agreed(trained(spark, sf, kind).scored))


def features_query(kind: str) -> None:
    rows = " UNION ALL ".join(f"SELECT {i} AS position, {sql_text(c)} AS feature" for i, c in enumerate(USED[kind]))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return local_table(spark, list(enumerate(trained(spark, sf, kind).features)), {"position": "int", "feature": "string"})

    query(f"training_features_{kind}", rows)(run)


def held_out_query(kind: str) -> None:
    listed = ", ".join(NUMBER_KEY)
    query(f"held_out_keys_{kind}", WITH_DECIDED + f"SELECT {listed} FROM decided WHERE {HELD_OUT[kind]}")(lambda spark, sf: trained(spark, sf, kind).scored.select(*NUMBER_KEY))


metrics_query("large", "forest_large_metrics")
for _kind in TRAINERS:
    features_query(_kind)
    held_out_query(_kind)


def bounds_query(kind: str, name: str) -> None:
    """Few trees, or a network, need not be exact, but must know nearly all rows."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return agreed(trained(spark, sf, kind).scored).select(*[(F.col(m) > 0.95).alias(m) for m in METRICS], "as_evaluator")

    query(name, "SELECT " + ", ".join(f"true AS {m}" for m in [*METRICS, "as_evaluator"]))(run)


bounds_query("light", "forest_light_metrics")
bounds_query("perceptron", "perceptron_metrics")


@lru_cache(maxsize=4)
def stored_forest(spark: SparkSession, sf: str) -> str:
    """The large forest as a stored pipeline, with its card."""
    found = trained(spark, sf, "large")
    return save_pipeline(found.model, scratch_path(spark, "forest"), found.card)


def held_out(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the keyed split that the stored forest was not trained on, cleaned as for training."""
    _, test = sampling.split_keyed(decided(spark, sf), NUMBER_KEY)
    return clean.fill_nonfinite(test, N.LABEL, keep=NUMBER_KEY)


TOP = 20


@query(
    "feature_importance",
    f"SELECT CAST({TOP} AS BIGINT) AS n, {sql_text(DECIDED_BY)} AS first, true AS falling, true AS sums_to_one, CAST({len(N.FEATURES)} AS BIGINT) AS features",
)
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the top 20 of 66: as many as asked, falling, the deciding feature first, and all of them sum to one."""
    top = stored.explain_stored(spark, stored_forest(spark, sf), top=TOP).collect()
    whole = stored.explain_stored(spark, stored_forest(spark, sf), top=len(N.FEATURES)).collect()
    weights = [r["importance"] for r in top]
    row = (len(top), top[0]["feature"], int(weights == sorted(weights, reverse=True)), int(abs(sum(r["importance"] for r in whole) - 1) < 1e-9), len({r["feature"] for r in whole}))
    facts = local_table(spark, [row], {"n": "bigint", "first": "string", "falling": "int", "sums_to_one": "int", "features": "bigint"})
    return facts.withColumns({c: F.col(c) == 1 for c in ("falling", "sums_to_one")})


@query("stored_model_metrics", ALL_RIGHT)
def stored_model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The stored forest, loaded again, on the part that it was not trained on."""
    return agreed(stored.evaluate_stored(stored_forest(spark, sf), held_out(spark, sf)).scored)


TRAINED_ON = f"count(*) FILTER (WHERE NOT ({HELD_OUT['large']}))"


@query(
    "stored_model_unseen_rows",
    WITH_DECIDED + f"SELECT count(*) AS rows, {TRAINED_ON} AS trained_on, CAST(0 AS BIGINT) AS not_finite, count(*) FILTER (WHERE {HELD_OUT['large']} AND \"Label\" = 'Other') AS unseen_label, "
    f"count(*) FILTER (WHERE {HELD_OUT['large']} AND \"Label\" <> 'Other') AS scored, f.* FROM (SELECT * REPLACE (CASE WHEN \"Label\" = 'Probe' THEN 'Other' ELSE \"Label\" END AS \"Label\") FROM decided), ({ALL_RIGHT}) f GROUP BY ALL",
)
def stored_model_unseen_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The stored forest on the whole table that it was trained on, with one class renamed: what is left out, and the metrics of the rest."""
    renamed = F.when(F.col(N.LABEL) == "Probe", "Other").otherwise(F.col(N.LABEL)).alias(N.LABEL)
    table_ = decided(spark, sf).select([renamed if c == N.LABEL else col(c) for c in decided(spark, sf).columns])
    checked = stored.evaluate_unseen(spark, stored_forest(spark, sf), table_)
    return checked.report.crossJoin(F.broadcast(agreed(checked.scored)))


INDEX_OF = "(SELECT label_index FROM idx WHERE name = \"Label\")"
WITH_INDEX = WITH_DECIDED.rstrip() + (
    f", idx AS (SELECT \"Label\" AS name, CAST(row_number() OVER (ORDER BY count(*) DESC, \"Label\") - 1 AS DOUBLE) AS label_index FROM decided WHERE NOT ({HELD_OUT['large']}) GROUP BY 1) "
)


@query("batch_scoring", WITH_INDEX + f"SELECT {', '.join(NUMBER_KEY)}, \"Label\", {INDEX_OF} AS label_index, {INDEX_OF} AS prediction FROM decided WHERE {HELD_OUT['large']}")
def batch_scoring(spark: SparkSession, sf: str) -> DataFrame:
    scored = stored.evaluate_stored(stored_forest(spark, sf), held_out(spark, sf)).scored
    return scored.select(*NUMBER_KEY, N.LABEL, features.LABEL_INDEX, "prediction")


@query("prediction_preview", "SELECT CAST(10 AS BIGINT) AS n, CAST(10 AS BIGINT) AS right_ones")
def prediction_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Ten rows as they come, all predicted right."""
    shown = models.preview(stored.evaluate_stored(stored_forest(spark, sf), held_out(spark, sf)).scored)
    return shown.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(features.LABEL_INDEX) == F.col("prediction")).alias("right_ones"))


@query("unseen_labels", WITH_FLOWS + 'SELECT "Label", count(*) AS skipped FROM flows WHERE "Label" IN (\'Probe\', \'Scan\') GROUP BY 1')
def unseen_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two classes that training never saw, as scoring reports them."""
    everything = flows(spark, sf)
    known = everything.filter(~col(N.LABEL).isin("Probe", "Scan"))
    model = Pipeline(stages=[features.label_indexer()]).fit(known)
    return features.unseen_labels(model, everything)
