"""Profiles: counts, class tables, missing and constant columns, copies, description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.values import col
from flowsieve.operators import clean, duplicates, profile
from flowsieve.queries.registry import (
    per_column_sql,
    query,
    round_columns,
    sql_name,
    sql_round,
    sql_text,
    table,
)
from flowsieve.queries.standin import COPY_OF, KEY, WITH_FLOWS, flows, plain_flows
from flowsieve.sources import footers, parquet
from flowsieve.sources.parquet import write_version
from flowsieve.sources.workspace import scratch_path

LINE_LABEL = "l_returnflag"
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("class_distribution", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_distribution(table(spark, sf, "lineitem"), LINE_LABEL)


def share_sql(label: str, source: str) -> str:
    share = sql_round("count(*) * 100.0 / sum(count(*)) OVER ()")
    return f"SELECT {label}, count(*) AS n, {share} AS share FROM {source} GROUP BY 1"


@query("class_share", share_sql(LINE_LABEL, "lineitem"))
def class_share(spark: SparkSession, sf: str) -> DataFrame:
    shares = profile.class_share(table(spark, sf, "lineitem"), LINE_LABEL)
    return round_columns(shares, ["share"])


@query("class_share_events", share_sql("event_type", "events"))
def class_share_events(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.class_share(table(spark, sf, "events"), "event_type"), ["share"])


@query("class_share_orders", share_sql("o_orderstatus", "orders"))
def class_share_orders(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.class_share(table(spark, sf, "orders"), "o_orderstatus"), ["share"])


@query("row_count", "SELECT count(*) AS rows FROM lineitem")
def row_count(spark: SparkSession, sf: str) -> DataFrame:
    return profile.row_count(parquet.read_parquet(spark, f"{sf}/lineitem.parquet"))


@query("dimensions", WITH_FLOWS + 'SELECT count(*) AS rows, 68 AS columns FROM flows')
def dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return profile.dimensions(flows(spark, sf))


@query(
    "index_histogram",
    WITH_FLOWS + 'SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, "Label") - 1 AS DOUBLE) AS label_index, '
    '"Label", count(*) AS n FROM flows GROUP BY "Label"',
)
def index_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.index_histogram(flows(spark, sf))


@query("class_count", "SELECT count(DISTINCT event_type) AS classes FROM events")
def class_count(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_count(table(spark, sf, "events"), "event_type")


def missing_sql(column: str) -> str:
    test = "IS NULL" if column in (N.LABEL, KEY) else f"IS NULL OR isnan({sql_name(column)})"
    return f"count(*) FILTER (WHERE {sql_name(column)} {test})"


@query("missing_features", per_column_sql("flows", N.FEATURES, {"missing": missing_sql}, WITH_FLOWS))
def missing_features(spark: SparkSession, sf: str) -> DataFrame:
    return profile.missing_counts(flows(spark, sf), exclude=[KEY, N.LABEL])


@query("missing_all", per_column_sql("flows", [KEY, N.LABEL, *N.FEATURES], {"missing": missing_sql}, WITH_FLOWS))
def missing_all(spark: SparkSession, sf: str) -> DataFrame:
    return profile.missing_counts(flows(spark, sf))


EXTRA = {
    "always_seven": "CAST(7 AS DOUBLE)",
    "never_there": "CAST(NULL AS DOUBLE)",
    "seven_or_nan": "CASE WHEN l_orderkey % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(7 AS DOUBLE) END",
    "seven_or_null": "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(7 AS DOUBLE) END",
    "rarely_eight": "CASE WHEN l_orderkey % 4999 = 1 THEN CAST(8 AS DOUBLE) ELSE CAST(7 AS DOUBLE) END",
    "one_word": "'same'",
}
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
EXTRA_SQL = ", ".join(f"{sql} AS {name}" for name, sql in EXTRA.items())


def constant_sql(column: str) -> str:
    value = f"CASE WHEN NOT isnan({column}) THEN {column} END" if column in EXTRA and column != "one_word" else column
    return f"min({value}) IS NOT DISTINCT FROM max({value})"


def present_sql(column: str) -> str:
    value = f"CASE WHEN NOT isnan({column}) THEN {column} END" if column in EXTRA and column != "one_word" else column
    return f"count({value})"


CONSTANT_SQL = per_column_sql(
    "wide", [*LINE_COLUMNS, *EXTRA], {"present": present_sql, "is_constant": constant_sql}, f"WITH wide AS (SELECT *, {EXTRA_SQL} FROM lineitem) "
)


@query("constant_columns", f'SELECT "column", present, is_constant FROM ({CONSTANT_SQL})')
def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    extra = [f"{sql} AS {name}" for name, sql in EXTRA.items()]
    return profile.constant_columns(table(spark, sf, "lineitem").selectExpr("*", *extra), exclude=[])


@query("stored_constants", f'SELECT "column", present, is_constant FROM ({CONSTANT_SQL})')
def stored_constants(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the written table: whole numbers from the footers, a scan of the others."""
    extra = [f"{sql} AS {name}" for name, sql in EXTRA.items()]
    path = write_version(table(spark, sf, "lineitem").selectExpr("*", *extra), scratch_path(spark, "wide"), "rows")
    return footers.stored_constants(spark, path, exclude=())


KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("stored_ranges", per_column_sql("lineitem", KEYS, {"present": "count({0})".format, "low": "CAST(min({0}) AS VARCHAR)".format, "high": "CAST(max({0}) AS VARCHAR)".format, "rows": lambda _: "count(*)"}))
def stored_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, and present, least and greatest keys of the stored lineitem, from its footers."""
    path = f"{sf}/lineitem.parquet"
    return footers.stored_ranges(spark, path, KEYS).withColumn("rows", F.lit(footers.stored_rows(spark, path)).cast("bigint"))


TYPE_SQL = (
    "CASE any_value(typeof({0})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END"
)


@query(
    "type_check",
    per_column_sql(
        "lineitem",
        LINE_COLUMNS,
        {
            "type": lambda c: TYPE_SQL.format(c),
            "should_be_numeric": lambda c: f"any_value(typeof({c})) = 'VARCHAR' AND '{c}' <> '{LINE_LABEL}'",
        },
    ),
)
def type_check(spark: SparkSession, sf: str) -> DataFrame:
    return profile.type_check(table(spark, sf, "lineitem"), LINE_LABEL)


NUMBER_METRICS = {
    "present": lambda c: f"count({c})",
    "mean": lambda c: sql_round(f"avg({c})", 4),
    "stddev": lambda c: sql_round(f"stddev_samp({c})", 4),
    "min": lambda c: f"CAST(min({c}) AS DOUBLE)",
    "max": lambda c: f"CAST(max({c}) AS DOUBLE)",
    "min_text": lambda c: "CAST(NULL AS VARCHAR)",
    "max_text": lambda c: "CAST(NULL AS VARCHAR)",
}
TEXT_METRICS = {
    "present": lambda c: f"count({c})",
    "mean": lambda c: "CAST(NULL AS DOUBLE)",
    "stddev": lambda c: "CAST(NULL AS DOUBLE)",
    "min": lambda c: "CAST(NULL AS DOUBLE)",
    "max": lambda c: "CAST(NULL AS DOUBLE)",
    "min_text": lambda c: f"min({c})",
    "max_text": lambda c: f"max({c})",
}


@query("describe_first_five", per_column_sql("lineitem", LINE_COLUMNS[:5], NUMBER_METRICS))
def describe_first_five(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.describe_columns(table(spark, sf, "lineitem")), ["mean", "stddev"], 4)


@query(
    "describe_mixed",
    f'SELECT * FROM ({per_column_sql("orders", ["o_orderstatus"], TEXT_METRICS)}) UNION ALL '
    'SELECT 1 AS position, "column", present, mean, stddev, "min", "max", min_text, max_text '
    f'FROM ({per_column_sql("orders", ["o_totalprice"], NUMBER_METRICS)})',
)
def describe_mixed(spark: SparkSession, sf: str) -> DataFrame:
    described = profile.describe_columns(table(spark, sf, "orders"), ["o_orderstatus", "o_totalprice"])
    return round_columns(described, ["mean", "stddev"], 4)


# All pairs of all columns are too many expressions for one statement: the columns are compared in long form, by a list of their
# texts in the order of the keys (a repeated key by value); text tells doubles apart but for minus zero, which the records do not hold.
LISTS_SQL = " UNION ALL ".join(
    f"SELECT {j} AS j, {sql_text(c)} AS name, md5(string_agg(coalesce(CAST({sql_name(c)} AS VARCHAR), 'null'), ',' ORDER BY {KEY}, {sql_name(c)})) AS texts FROM flows" for j, c in enumerate(N.FEATURES)
)


@query(
    "duplicate_candidates",
    WITH_FLOWS + f", lists AS MATERIALIZED ({LISTS_SQL}), first AS (SELECT texts, min(j) AS i FROM lists GROUP BY texts) "
    "SELECT l.name AS copy, o.name AS original FROM lists l JOIN first f ON l.texts = f.texts JOIN lists o ON o.j = f.i WHERE l.j <> f.i",
)
def duplicate_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_candidates(plain_flows(spark, sf).select([col(c) for c in N.FEATURES]))


@query(
    "duplicate_columns",
    WITH_FLOWS
    + " UNION ALL ".join(
        f"SELECT {sql_text(c)} AS copy, {sql_text(o)} AS original, "
        f"count(*) FILTER (WHERE {sql_name(c)} IS DISTINCT FROM {sql_name(o)}) AS differences, TRUE AS confirmed FROM flows"
        for c, o in COPY_OF.items()
    ),
)
def duplicate_columns(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_columns(plain_flows(spark, sf))


CHECKED = [("Subflow Fwd Pkts", "Tot Fwd Pkts"), ("Flow Byts/s", "Flow Byts/s"), ("Idle Min", "Idle Max"), ("Active Std", "Flow IAT Min")]


@query(
    "duplicate_verification",
    WITH_FLOWS
    + "SELECT *, differences = 0 AS confirmed FROM ("
    + " UNION ALL ".join(
        f"SELECT {sql_text(c)} AS copy, {sql_text(o)} AS original, "
        f"count(*) FILTER (WHERE {sql_name(c)} IS DISTINCT FROM {sql_name(o)}) AS differences FROM flows"
        for c, o in CHECKED
    )
    + ")",
)
def duplicate_verification(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_verification(plain_flows(spark, sf), CHECKED)


KEPT = [c for c in N.FEATURES if c not in N.KNOWN_COPIES]


@query(
    "drop_duplicate_columns",
    per_column_sql(
        "flows",
        KEPT,
        {
            "low": lambda c: f"min({sql_name(c)}) FILTER (WHERE isfinite({sql_name(c)}))",
            "high": lambda c: f"max({sql_name(c)}) FILTER (WHERE isfinite({sql_name(c)}))",
        },
        WITH_FLOWS,
    ),
)
def drop_duplicate_columns(spark: SparkSession, sf: str) -> DataFrame:
    """What is left, column by column, as the range of the finite values."""
    kept = duplicates.drop_duplicate_columns(plain_flows(spark, sf))
    features = clean.feature_names(kept)
    finite = {c: F.when(clean.finite(c), col(c)) for c in features}
    return profile.column_profile(kept, finite, {"low": profile.Metric(F.min), "high": profile.Metric(F.max)})


@query(
    "schema_report",
    per_column_sql(
        "flows",
        [KEY, N.LABEL, *N.FEATURES],
        {
            "type": lambda c: TYPE_SQL.format(sql_name(c)),
            "should_be_numeric": lambda c: f"any_value(typeof({sql_name(c)})) = 'VARCHAR' AND {sql_text(c)} <> '{N.LABEL}'",
        },
        WITH_FLOWS,
    ),
)
def schema_report(spark: SparkSession, sf: str) -> DataFrame:
    return profile.type_check(flows(spark, sf))


@query("partition_rows", "SELECT count(*) AS \"rows\", true AS all_in_range FROM lineitem")
def partition_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The partition report adds up to the table, and its partitions are numbered from 0."""
    lines = table(spark, sf, "lineitem")
    report = profile.partition_rows(lines)
    in_range = F.min("partition") >= 0
    return report.agg(F.sum("rows").alias("rows"), (in_range & (F.max("partition") < lines.rdd.getNumPartitions())).alias("all_in_range"))


@query("cached_projection", "SELECT l_returnflag AS label, l_linestatus AS prediction, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS \"rows\" FROM lineitem GROUP BY 1, 2")
def cached_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns kept while a row count and a count table are taken from them; both are in the answer."""
    from flowsieve.functions.tables import local_table
    from flowsieve.operators.metrics import cached_projection as kept_columns, confusion_counts

    with kept_columns(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]) as kept:
        rows = kept.count()
        counts = [(r["label"], r["prediction"], r["n"], rows) for r in confusion_counts(kept, "l_returnflag", "l_linestatus").collect()]  # classes squared at most
    return local_table(spark, counts, {"label": "string", "prediction": "string", "n": "bigint", "rows": "bigint"})
