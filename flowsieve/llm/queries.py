"""The operators of this subpackage as queries over the test tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.balanced_packing import balanced_pack
from flowsieve.llm.bpe import RoundTrip, bpe_encode
from flowsieve.llm.conversation_repair import diagnosed, digests, repaired
from flowsieve.llm.embedding_dedup import near_vectors
from flowsieve.llm.exact_dedup import exact_dedup
from flowsieve.llm.manifest import leaf_digest, manifest
from flowsieve.llm.minhash import near_duplicates
from flowsieve.llm.packing import pack
from flowsieve.llm.pii import find_private
from flowsieve.llm.secrets import find_secrets
from flowsieve.llm.sharding import shuffle_shards
from flowsieve.llm.sql import CONVERSATION_REPAIR, MERKLE_MANIFEST
from flowsieve.llm.tables import stored
from flowsieve.llm.toxicity import toxicity
from flowsieve.llm.url_filter import filter_urls
from flowsieve.queries.registry import query, table

ASCII_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256({ASCII_LOWER_SQL}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = exact_dedup(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op6_uniform_shards")
def op6_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shuffle_shards(table(spark, sf_dir, "documents"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


@query("op1_private_data")
def op1_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[of_kind("base", k) for k in ("email", "ip", "card", "phone")], "base_sha256", span_text("spans").alias("spans"))


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[of_kind("base", k) for k in ("assign", "access", "hex")], "base_sha256", span_text("spans").alias("spans"))


# The test tables hold no fetch dates and no lists: both are derived from the pages, by the same SQL in either engine.
DRAW = {"spark": "cast(conv(substring(md5({0}), 1, 8), 16, 10) as bigint)", "duckdb": "cast('0x' || substring(md5({0}), 1, 8) as bigint)"}


def captures_sql(engine: str) -> str:
    day = DRAW[engine].format("concat('fetch', cast(page_id as varchar(20)))")
    return f"SELECT page_id, url, cast({day} % 720 as int) AS fetch_day FROM pages"


def list_log_sql(engine: str) -> str:
    """Three dated changes for two fifths of the hosts, and for the hosts above them."""

    def draw(name: str) -> str:
        return DRAW[engine].format(f"concat('{name}', pattern)")

    host = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1))"
    first, second = f"({draw('first')} % 400)", f"(1 + {draw('second')} % 200)"
    verdict = f"CASE WHEN {draw('verdict')} % 4 = 0 THEN 'allow' ELSE 'block' END"
    change = "SELECT pattern, cast({0} as int) AS day, '{1}' AS action, {2} AS verdict FROM listed"
    return f"""
WITH hosts AS (SELECT DISTINCT {host} AS pattern FROM pages WHERE url IS NOT NULL),
wider AS (SELECT pattern FROM hosts UNION SELECT regexp_replace(pattern, '^[^.]+[.]', '') FROM hosts),
listed AS (SELECT pattern FROM wider WHERE pattern LIKE '%.%.%' AND {draw('listed')} % 5 < 2)
{change.format(first, 'add', verdict)} UNION ALL {change.format(f'{first} + {second}', 'remove', verdict)}
UNION ALL {change.format(f'{first} + 2 * {second}', 'add', "'block'")}"""


@query("op9_url_filter", f"""
WITH log AS ({list_log_sql('duckdb')}), captures AS ({captures_sql('duckdb')}),
placed AS (SELECT *, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), '')) AS host FROM captures),
valid AS (SELECT *, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM log),
met AS (SELECT DISTINCT host, fetch_day, pattern, verdict, day AS since FROM placed JOIN valid
  ON (host = pattern OR ends_with(host, '.' || pattern)) AND action = 'add' AND day <= fetch_day AND (until IS NULL OR fetch_day < until)
  QUALIFY row_number() OVER (PARTITION BY host, fetch_day ORDER BY length(pattern) DESC) = 1)
SELECT page_id, url, r.host, r.fetch_day, coalesce(verdict = 'block', false) AS blocked, pattern, verdict, since
FROM placed r LEFT JOIN met m ON r.host = m.host AND r.fetch_day = m.fetch_day""")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures, log = (spark.sql(sql("spark").replace("FROM pages", "FROM {pages}"), pages=pages) for sql in (captures_sql, list_log_sql))
    return filter_urls(captures, log)


def byte_50k_files() -> tuple[str, str, dict[str, int]]:
    """The ranks of byte_bpe_50k.json, the pattern before its merges, and its added token."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_50k_files())


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, result=RoundTrip(ranks, vocabulary=50_256))


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op8_embedding_near_dedup")
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query("op12_merkle_manifest", MERKLE_MANIFEST)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id, by its checksum, claims one more character than its document has."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    n_chars = (F.col("n_chars").cast("decimal(20,0)") + tampered).cast("decimal(20,0)")
    leaf, claimed = (leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]) for n in (F.col("n_chars"), n_chars))
    return manifest(docs, "doc_id", "lang", leaf, claimed).withColumnsRenamed({"leaf_id": "doc_id", "tree_group": "lang"})


@query("op13_balanced_packing")
def op13_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_pack(table(spark, sf_dir, "documents"), byte_50k_files())


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of conversation and turn; null stands as one space."""
    known = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    spot = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(spot) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(F.col("role"))
    changed = known.filter(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("times"))
    return changed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


@query("op11_conversation_repair", CONVERSATION_REPAIR)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    found = stored(diagnosed(rows), "diagnosed")
    sums = digests(repaired(rows, found.select("conv_id", "audit")))
    every = conversations.select("conv_id").distinct()
    every = every.join(found.withColumnRenamed("conv_id", "found_id"), F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    every = every.join(sums.withColumnRenamed("conv_id", "sum_id"), F.col("conv_id").eqNullSafe(F.col("sum_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
