"""Sampling, splitting and balancing over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import names as N
from flowsieve.operators import profile, sampling
from flowsieve.queries.profiles import LINE_LABEL
from flowsieve.queries.registry import query, rounded, sql_round, table
from flowsieve.queries.standin import KEY, LINE_KEY, WITH_FLOWS, flows

DRAW_RANGE = "4294967296.0"


def draw_sql(keys: list[str], seed: int = sampling.SAMPLE_SEED) -> str:
    texts = [f"CAST({k} AS VARCHAR)" for k in keys]
    fields = " || ".join(f"coalesce('v' || length({t}) || ':' || {t}, 'n')" for t in texts)
    return f"CAST('0x' || substr(md5('{seed}|' || {fields}), 1, 8) AS BIGINT)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


@query("sample_keyed", f"SELECT event_id, user_id, event_type, value FROM events WHERE {draw_sql(['event_id'])} < 0.1 * {DRAW_RANGE}")
def sample_keyed(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return sampling.sample_keyed(events, 0.1, ["event_id"])


def sample_facts(part: DataFrame, whole: DataFrame, low: float, high: float) -> DataFrame:
    """What holds for any sample: its share of the rows lies in the bounds, no row comes twice, none is a stranger, and every sixteenth of the keys has some."""
    order = F.floor(F.col("l_orderkey") * 16 / (whole.agg(F.max("l_orderkey")).scalar() + 1))
    share = F.count(F.lit(1)) / whole.agg(F.count(F.lit(1))).scalar()
    found = part.agg(
        share.between(low, high).alias("share_in_bounds"),
        (F.count(F.lit(1)) - F.countDistinct(*LINE_KEY)).alias("repeated"),
        F.countDistinct(order).alias("sixteenths"),
    )
    strangers = part.join(whole, LINE_KEY, "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    return found.crossJoin(strangers)


ANY_SAMPLE = "SELECT true AS share_in_bounds, CAST(0 AS BIGINT) AS repeated, CAST(16 AS BIGINT) AS sixteenths, CAST(0 AS BIGINT) AS strangers"


@query("sample_native", ANY_SAMPLE)
def sample_native(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of Spark's own sample; its rows depend on the partitions."""
    whole = lines(spark, sf).select(*LINE_KEY)
    return sample_facts(sampling.sample(whole, 0.1), whole, 0.08, 0.12)


CAP = 500


@query(
    "sample_capped_keyed",
    f"SELECT event_id, user_id, event_type, value FROM events WHERE {draw_sql(['event_id'])} < 0.1 * {DRAW_RANGE} "
    f"ORDER BY {draw_sql(['event_id'])}, event_id LIMIT {CAP}",
)
def sample_capped_keyed(spark: SparkSession, sf: str) -> DataFrame:
    kept = sampling.sample_capped_keyed(table(spark, sf, "events"), 0.1, CAP, ["event_id"])
    return kept.select("event_id", "user_id", "event_type", "value")


@query("sample_capped_native", f"SELECT CAST({CAP} AS BIGINT) AS n, f.* FROM ({ANY_SAMPLE}) f")
def sample_capped_native(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the native capped sample: exactly the cap, from everywhere."""
    whole = lines(spark, sf).select(*LINE_KEY)
    kept = sampling.sample_capped(whole, 0.1, CAP)
    return kept.agg(F.count(F.lit(1)).alias("n")).crossJoin(sample_facts(kept, whole, 0.0, 0.1))


@query("head_sample", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 200")
def head_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.head_sample(table(spark, sf, "events"), 200, ["event_id"]).select("event_id", "event_type", "value")


@query("split_keyed", f"SELECT {', '.join(LINE_KEY)}, CASE WHEN {draw_sql(LINE_KEY)} < 0.7 * {DRAW_RANGE} THEN 'train' ELSE 'test' END AS part FROM lineitem")
def split_keyed(spark: SparkSession, sf: str) -> DataFrame:
    train, test = sampling.split_keyed(lines(spark, sf).select(*LINE_KEY), LINE_KEY)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("split_native", f"SELECT {', '.join(LINE_KEY)}, CAST(1 AS BIGINT) AS parts, true AS share_in_bounds FROM lineitem GROUP BY ALL")
def split_native(spark: SparkSession, sf: str) -> DataFrame:
    """Spark's own split: every row is in exactly one part, and the first part has about its share."""
    train, test = sampling.split(lines(spark, sf).select(*LINE_KEY))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    share = train.agg(F.count(F.lit(1))).scalar() / both.agg(F.count(F.lit(1))).scalar()
    return both.groupBy(*LINE_KEY).agg(F.count_distinct("part").alias("parts")).withColumn("share_in_bounds", share.between(0.67, 0.73))


TARGET = 5000


def fractions_sql(target: int) -> str:
    fraction = f"CASE WHEN \"Label\" = 'Benign' THEN least(1.0, CAST({target} AS DOUBLE) / count(*)) ELSE CAST(1 AS DOUBLE) END"
    return WITH_FLOWS + f'SELECT "Label", count(*) AS n, {sql_round(fraction)} AS fraction FROM flows GROUP BY "Label"'


@query("balance_fractions", fractions_sql(TARGET))
def balance_fractions(spark: SparkSession, sf: str) -> DataFrame:
    fractions = sampling.balance_fractions(flows(spark, sf), target=TARGET)
    return fractions.withColumn("fraction", rounded("fraction"))


@query("balance_fractions_clamped", fractions_sql(1_000_000_000))
def balance_fractions_clamped(spark: SparkSession, sf: str) -> DataFrame:
    fractions = sampling.balance_fractions(flows(spark, sf), target=1_000_000_000)
    return fractions.withColumn("fraction", rounded("fraction"))


BALANCED_SQL = (
    f'SELECT {KEY}, "Label" FROM flows WHERE "Label" <> \'Benign\' OR {draw_sql([KEY])} < '
    f"least(1.0, CAST({TARGET} AS DOUBLE) / (SELECT count(*) FROM flows WHERE \"Label\" = 'Benign')) * {DRAW_RANGE}"
)


@query("balance_keyed", WITH_FLOWS + BALANCED_SQL)
def balance_keyed(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balance_keyed(flows(spark, sf), [KEY], target=TARGET).select(KEY, N.LABEL)


BALANCED_COUNTS = (
    "SELECT \"Label\", CASE WHEN \"Label\" = 'Benign' THEN NULL ELSE count(*) END AS n, true AS in_bounds FROM flows "
    'WHERE "Label" IS NOT NULL GROUP BY "Label"'
)


@query("balance_native", WITH_FLOWS + BALANCED_COUNTS)
def balance_native(spark: SparkSession, sf: str) -> DataFrame:
    """Spark's own stratified sample: minorities untouched, the majority within a tenth of its target (or whole below it)."""
    everything = flows(spark, sf)
    majority = everything.filter(F.col(N.LABEL) == N.MAJORITY).agg(F.count(F.lit(1))).scalar()
    counts = profile.class_counts(sampling.balance(everything, target=TARGET), N.LABEL)
    is_majority, wanted = F.col(N.LABEL) == N.MAJORITY, F.least(majority, F.lit(TARGET))
    return counts.select(N.LABEL, F.when(~is_majority, F.col("n")).alias("n"), (~is_majority | F.col("n").between(0.9 * wanted, 1.1 * wanted)).alias("in_bounds"))


EXACT = {"Benign": TARGET, "Flood": 700, "Scan": 1_000_000_000}
EXACT_SQL = "CASE \"Label\" " + " ".join(f"WHEN '{name}' THEN {rows}" for name, rows in EXACT.items()) + " ELSE 9000000000 END"


@query(
    "balance_exact",
    WITH_FLOWS + f'SELECT {KEY}, "Label" FROM flows WHERE "Label" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "Label" ORDER BY {draw_sql([KEY])}, {KEY}) <= {EXACT_SQL}',
)
def balance_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Two classes cut to exact numbers of rows, one with fewer rows than its target, one without."""
    return sampling.balance_exact(flows(spark, sf), [KEY], targets=EXACT).select(KEY, N.LABEL)
