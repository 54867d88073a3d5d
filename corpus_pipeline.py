"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept and returns their columns; the last returns the
packed pieces. The driver writes every stage's result and hands the written table to the next one.

All stages: null text is the empty text and stays null; a null id is an id like any other; empty and very long texts are read whole;
extra columns of any name keep their values; an empty table gives no rows. What is special to a stage is stated there.
`ORACLE_SQL` is None, as SQL can express neither the boosted trees nor the token merges; the tests hold
every stage against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.exact_dedup import keep_one
from flowsieve.llm.minhash import keep_representatives
from flowsieve.llm.packing import pack
from flowsieve.llm.pii import sanitise
from flowsieve.llm.queries import byte_50k_files
from flowsieve.llm.tables import stored
from flowsieve.llm.toxicity import keep_clean
from flowsieve.queries.registry import query, table

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or above the toxicity threshold go.

    Ties at the threshold go. Repeated rows have the same score and go or stay together. Without labels of both classes nothing goes.
    """
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    Texts without any word are equal like others. Of rows that repeat id and text one stays; a null id stays only where the whole group has none.
    """
    return keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays.

    Texts without any word are near to nothing and stay. Of rows that repeat id and text one stays; a null id counts after all others.
    """
    return keep_representatives(docs)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised or removed; `n_chars` follows the new text.

    Every row stays. Rows that repeat id and text get the same text, and count as documents each. Of overlapping spans the first, then the longest, is replaced.
    """
    cleaned = sanitise(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces with their places in sequences of 1024.

    An empty text is its end token. Repeated rows are packed as often as they occur; pieces of equal length take places in no stated order. Extra columns are not returned.
    """
    return pack(docs, byte_50k_files())


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("minhash_near_dedup", near_stage), ("private_data", private_stage), ("best_fit_packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline", ORACLE_SQL)(run)
