"""Row and column cleaning over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.functions.values import col, differs
from flowsieve.operators import clean
from flowsieve.queries.profiles import LINE_FEATURES, LINE_LABEL
from flowsieve.queries.registry import query, rounded, sql_name, sql_round, table
from flowsieve.queries.standin import KEY, KEY_SQL, LABEL_SQL, WITH_FLOWS, flows

# Text as a raw file would hold it: repeated header lines, unlabelled rows, and words in a number column.
RAW_LABEL = f"CASE WHEN l_orderkey % 53 = 0 THEN 'Label' WHEN l_orderkey % 59 = 1 THEN NULL ELSE {LABEL_SQL} END"
RAW_RATE = (
    "CASE WHEN l_orderkey % 11 = 0 THEN 'abc' WHEN l_orderkey % 11 = 1 THEN '' WHEN l_orderkey % 11 = 2 THEN 'NaN' "
    "WHEN l_orderkey % 11 = 3 THEN 'Infinity' WHEN l_orderkey % 11 = 4 THEN '-Infinity' "
    "WHEN l_orderkey % 11 = 5 THEN ' 2 ' WHEN l_orderkey % 11 = 6 THEN '1e3' "
    "ELSE CAST(l_extendedprice AS VARCHAR(30)) END"
)
RAW_SQL = f"SELECT {KEY_SQL} AS {KEY}, {RAW_LABEL} AS \"Label\", {RAW_RATE} AS rate, l_shipmonth AS \"Timestamp\" FROM (SELECT *, CAST(l_linenumber AS VARCHAR(5)) AS l_shipmonth FROM lineitem)"
WITH_RAW = f"WITH raw AS ({RAW_SQL}) "


def raw(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.selectExpr(
        f"{KEY_SQL} AS {KEY}", f"{RAW_LABEL} AS {N.LABEL}", f"{RAW_RATE} AS rate", "CAST(l_linenumber AS STRING) AS Timestamp"
    )


# One dirty column of each kind on top of lineitem.
DIRTY = {
    "x": "CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 7 = 1 THEN CAST('NaN' AS DOUBLE) "
    "WHEN l_orderkey % 7 = 2 THEN CAST('Infinity' AS DOUBLE) WHEN l_orderkey % 7 = 3 THEN CAST('-Infinity' AS DOUBLE) "
    "ELSE l_extendedprice END",
    "y": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_linenumber END",
}
WITH_DIRTY = f"WITH dirty AS (SELECT {KEY_SQL} AS {KEY}, l_returnflag AS \"Label\", " + ", ".join(f"{s} AS {c}" for c, s in DIRTY.items()) + " FROM lineitem) "


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    columns = [f"{sql} AS {name}" for name, sql in DIRTY.items()]
    return table(spark, sf, "lineitem").selectExpr(f"{KEY_SQL} AS {KEY}", f"l_returnflag AS {N.LABEL}", *columns)


def state(column: str) -> Column:
    c = col(column)
    return (
        F.when(c.isNull(), "null").when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise("number")
    )


def state_sql(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN 'null' WHEN isnan({column}) THEN 'nan' "
        f"WHEN {column} = CAST('Infinity' AS DOUBLE) THEN 'inf' WHEN {column} = CAST('-Infinity' AS DOUBLE) THEN '-inf' ELSE 'number' END"
    )


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Key and label with state and finite value of each named column."""
    parts = []
    for c in columns:
        number = col(c).cast("double")
        parts += [state(c).alias(f"{c}_state"), F.when(state(c) == "number", number).otherwise(F.lit(0.0)).alias(f"{c}_value")]
    return df.withColumns({c: col(c).cast("double") for c in columns}).select(KEY, N.LABEL, *parts)


def shown_sql(columns: list[str], source: str, where: str = "") -> str:
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    parts = ", ".join(
        f"{state_sql(c)} AS {c}_state, CASE WHEN {state_sql(c)} = 'number' THEN {c} ELSE 0.0 END AS {c}_value" for c in columns
    )
    return f'SELECT {KEY}, "Label", {parts} FROM (SELECT {KEY}, "Label", {cast} FROM {source} {where})'


@query("drop_repeated_headers", WITH_RAW + f'SELECT {KEY}, "Label" FROM raw WHERE "Label" <> \'Label\'')
def drop_repeated_headers(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_repeated_headers(raw(spark, sf)).select(KEY, N.LABEL)


@query("drop_if_present", WITH_RAW + f'SELECT {KEY}, "Label", rate FROM raw')
def drop_if_present(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_if_present(raw(spark, sf), N.RAW_DROP)


@query("cast_features", WITH_RAW + shown_sql(["rate"], f'(SELECT {KEY}, "Label", TRY_CAST(trim(rate) AS DOUBLE) AS rate FROM raw)'))
def cast_features(spark: SparkSession, sf: str) -> DataFrame:
    return shown(clean.cast_features(clean.drop_if_present(raw(spark, sf), N.RAW_DROP), keep=[KEY]), "rate")


@query("keep_present", WITH_DIRTY + shown_sql(["x"], "dirty", "WHERE x IS NOT NULL AND NOT isnan(x)"))
def keep_present(spark: SparkSession, sf: str) -> DataFrame:
    return shown(clean.keep_present(dirty(spark, sf), "x"), "x")


@query("drop_nonfinite_rows", WITH_DIRTY + shown_sql(["x", "y"], "dirty", "WHERE x IS NOT NULL AND isfinite(x) AND y IS NOT NULL"))
def drop_nonfinite_rows(spark: SparkSession, sf: str) -> DataFrame:
    return shown(clean.drop_nonfinite_rows(dirty(spark, sf)), "x", "y")


ALL_FINITE = " AND ".join(f"isfinite({sql_name(c)})" for c in N.FEATURES)


@query("drop_nonfinite_flows", WITH_FLOWS + f'SELECT {KEY}, "Label" FROM flows WHERE {ALL_FINITE}')
def drop_nonfinite_flows(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_nonfinite_rows(flows(spark, sf)).select(KEY, N.LABEL)


FILLED = "CASE WHEN x IS NULL OR isnan(x) THEN 0.0 ELSE x END AS x, coalesce(y, 0) AS y"


@query("fill_missing", WITH_DIRTY + shown_sql(["x", "y"], f'(SELECT {KEY}, "Label", {FILLED} FROM dirty)'))
def fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    return shown(clean.fill_missing(dirty(spark, sf)), "x", "y")


@query("numerics_to_double", "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LINE_FEATURES) + ", l_returnflag FROM lineitem")
def numerics_to_double(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(*LINE_FEATURES, LINE_LABEL)
    return clean.numerics_to_double(lines)


NONFINITE = "CASE WHEN x IS NULL OR NOT isfinite(x) THEN 0.0 ELSE x END AS x, CAST(coalesce(y, 0) AS DOUBLE) AS y"


@query("fill_nonfinite", WITH_DIRTY + f'SELECT {KEY}, "Label", {NONFINITE} FROM dirty')
def fill_nonfinite(spark: SparkSession, sf: str) -> DataFrame:
    return clean.fill_nonfinite(dirty(spark, sf))


@query("select_features", "SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber FROM lineitem")
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    return clean.select_features(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"], LINE_LABEL)


LIGHT = [c for c in N.FEATURES if c not in N.REDUNDANT]


@query("select_light_features", WITH_FLOWS + 'SELECT "Label", ' + ", ".join(sql_round(f"CASE WHEN isfinite({sql_name(c)}) THEN {sql_name(c)} ELSE 0 END", 4) + f" AS {sql_name(c)}" for c in LIGHT) + " FROM flows")
def select_light_features(spark: SparkSession, sf: str) -> DataFrame:
    chosen = clean.select_features(flows(spark, sf), [*N.NOT_FEATURES, *N.REDUNDANT], N.LABEL)
    filled = clean.fill_nonfinite(chosen)
    return filled.select(N.LABEL, *[rounded(col(c), 4).alias(c) for c in LIGHT])


@query("binary_label", WITH_FLOWS + f"SELECT {KEY}, CASE WHEN \"Label\" = 'Benign' THEN 'Benigno' ELSE 'Ataque' END AS \"Clase\" FROM flows")
def binary_label(spark: SparkSession, sf: str) -> DataFrame:
    return clean.binary_label(flows(spark, sf)).select(KEY, N.BINARY_COLUMN)


@query("null_safe_difference", WITH_DIRTY + f"SELECT {KEY}, x IS DISTINCT FROM CAST(y AS DOUBLE) AS differs FROM dirty")
def null_safe_difference(spark: SparkSession, sf: str) -> DataFrame:
    return dirty(spark, sf).select(KEY, differs("x", "y").alias("differs"))


@query("label_to_string", "SELECT vec_id, CAST(label AS VARCHAR) AS label FROM embeddings")
def label_to_string(spark: SparkSession, sf: str) -> DataFrame:
    cast = clean.label_to_string(table(spark, sf, "embeddings"), "label")
    return cast.select("vec_id", "label")


def report_sql(step: str, condition: str) -> str:
    kept = f"count(*) FILTER (WHERE {condition})"
    return f"SELECT '{step}' AS step, count(*) AS rows_before, count(*) - {kept} AS rows_removed, {kept} AS rows_kept FROM dirty"


@query(
    "row_report",
    WITH_DIRTY + report_sql("present", "x IS NOT NULL AND NOT isnan(x)") + " UNION ALL " + report_sql("finite", "x IS NOT NULL AND isfinite(x) AND y IS NOT NULL"),
)
def row_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows before, removed and kept by two row filters, without running them one by one."""
    rows = dirty(spark, sf)
    return clean.row_report(rows, {"present": clean.is_present("x"), "finite": clean.is_finite_row(rows)})
