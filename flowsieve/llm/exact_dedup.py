"""Exact deduplication through a minimal perfect hash over historical distinct digests.

Rows of the history are reduced to their distinct digests. Digests are dealt by their first eight
bytes to segments of about `SEGMENT` keys, and each segment gets a minimal perfect hash: one pilot
number for every few keys moves them to free slots, so that n keys fill exactly n slots. A slot holds
the full digest and the locator of its winner. New rows are reduced to distinct digests too and looked
up in their segment: the hash gives a slot for any key, so all 32 bytes are compared before it counts
as known. Digests that no slot holds form their own groups.

Null text counts as empty. Only A-Z is lower-cased. Of equal texts the largest id stays; a null id loses
to any other, and stays only where all ids of the group are null. Rows that share text and the winning
id are all marked kept: they are one document said more than once (`keep_one` reduces them to one row).
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.values import col
from flowsieve.llm.tables import ascii_lower, filled, free_names, id_type, join_large_groups, sha256_values, stored

SEGMENT = 1024
KEYS_PER_PILOT = 4
TRIES = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


# --- the hash of one segment


def key_words(digests: list[bytes]) -> np.ndarray:
    """Each 32-byte digest as four unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def slots_for(words: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key under its pilot."""
    x = words[:, 2] + pilots * (words[:, 3] | np.uint64(1))
    x = (x ^ (x >> np.uint64(32))) * MIX
    return (x ^ (x >> np.uint64(29))) % np.uint64(n)


def pilot_of(words: np.ndarray, n_pilots: int) -> np.ndarray:
    return words[:, 1] % np.uint64(n_pilots)


def build_pilots(words: np.ndarray) -> np.ndarray:
    """Pilots under which distinct keys fill the slots 0 to n-1; the largest buckets choose first."""
    n = len(words)
    n_pilots = n // KEYS_PER_PILOT + 1
    bucket = pilot_of(words, n_pilots)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_pilots + 1, dtype=np.uint64))
    pilots = np.zeros(n_pilots, dtype=np.uint64)
    taken = np.zeros(n, dtype=bool)
    for b in np.argsort(bounds[:-1] - bounds[1:], kind="stable"):
        keys = words[order[bounds[b] : bounds[b + 1]]]
        if not len(keys):
            break
        first = 0
        while True:
            tries = np.arange(first, first + TRIES, dtype=np.uint64)
            slots = slots_for(np.repeat(keys, TRIES, axis=0), np.tile(tries, len(keys)), n).reshape(len(keys), TRIES)
            ranked = np.sort(slots, axis=0)
            good = ~taken[slots].any(axis=0) & (ranked[1:] != ranked[:-1]).all(axis=0)
            if good.any():
                chosen = int(np.argmax(good))
                pilots[b] = tries[chosen]
                taken[slots[:, chosen]] = True
                break
            first += TRIES
    return pilots


# --- the index as a table


def with_segment(df: DataFrame, segments: int) -> DataFrame:
    number = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("bigint")
    return df.withColumn("segment", F.pmod(number, F.lit(segments)))


def build_index(groups: DataFrame, segments: int) -> DataFrame:
    """One row per segment from one row per distinct digest (digest, winner, n): pilots and slots in order."""
    kind = id_type(groups, "winner")

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words = key_words(table["digest"].to_pylist())
        pilots = build_pilots(words)
        slots = slots_for(words, pilots[pilot_of(words, len(pilots))], len(words))
        by_slot = table.take(pa.array(np.argsort(slots)))
        return pa.table({
            "segment": table["segment"].slice(0, 1),
            "pilots": pa.array([pilots.tobytes()], pa.binary()),
            "digests": pa.array([b"".join(by_slot["digest"].to_pylist())], pa.binary()),
            "winners": pa.array([by_slot["winner"].to_pylist()], pa.list_(table.schema.field("winner").type)),
            "counts": pa.array([by_slot["n"].to_pylist()], pa.list_(pa.int64())),
        })

    return with_segment(groups, segments).groupBy("segment").applyInArrow(
        build, f"segment bigint, pilots binary, digests binary, winners array<{kind}>, counts array<bigint>"
    )


def merge_batch(index: DataFrame, batch: DataFrame, segments: int) -> DataFrame:
    """Look up a batch of distinct digests (digest, winner, n); one row per digest of either side.

    `in_history` tells whether a slot holds the digest. A member's group takes the larger winner.
    """
    kind = id_type(batch, "winner")

    def better(a, b):
        return b if a is None else a if b is None else max(a, b)

    def look_up(slots: pa.Table, new: pa.Table) -> pa.Table:
        held = slots.to_pylist()[0] if slots.num_rows else None
        digests, winners, counts, known = [], [], [], []
        if held:
            size = len(held["counts"])
            digests = [held["digests"][32 * i : 32 * i + 32] for i in range(size)]
            winners, counts, known = list(held["winners"]), list(held["counts"]), [True] * size
        if new.num_rows:
            keys, ids, sizes = (new[c].to_pylist() for c in ("digest", "winner", "n"))
            if held:
                words, pilots = key_words(keys), np.frombuffer(held["pilots"], dtype=np.uint64)
                at = slots_for(words, pilots[pilot_of(words, len(pilots))], size).tolist()
            for i, (key, winner, n) in enumerate(zip(keys, ids, sizes)):
                if held and digests[at[i]] == key:
                    winners[at[i]], counts[at[i]] = better(winners[at[i]], winner), counts[at[i]] + n
                else:
                    digests.append(key), winners.append(winner), counts.append(n), known.append(False)
        winner_type = new.schema.field("winner").type if new.num_rows else slots.schema.field("winners").type.value_type
        return pa.table([pa.array(digests, pa.binary()), pa.array(winners, winner_type), pa.array(counts, pa.int64()), pa.array(known, pa.bool_())],
                        names=["digest", "winner", "n", "in_history"])

    keyed = with_segment(batch, segments)
    return index.groupBy("segment").cogroup(keyed.groupBy("segment")).applyInArrow(
        look_up, f"digest binary, winner {kind}, n bigint, in_history boolean"
    )


# --- the operator


def with_digest(docs: DataFrame, name: str, text_column: str = "text") -> DataFrame:
    """The documents with the SHA-256 of their normalised text as one more column."""
    digest = F.arrow_udf(lambda texts: sha256_values(ascii_lower(filled(texts))), "binary")
    return docs.withColumn(name, digest(col(text_column).cast("string")))


def exact_dedup(docs: DataFrame, history: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, in_history.

    `history` says which rows came earlier and are indexed; by default half of the rows, by a hash of the id.
    The outcome is the same whichever rows it takes.
    """
    early = F.xxhash64(F.lit("history"), col(id_column)) >= 0 if history is None else F.coalesce(history, F.lit(False))
    chosen = docs.select(col(id_column).alias("doc_id"), col(text_column).cast("string").alias("text"), early.alias("early"))
    rows = stored(with_digest(chosen, "digest").drop("text"), "digests")
    groups = stored(rows.groupBy("early", "digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n")), "digest-groups")
    sizes = {r["early"]: (r["digests"], r["rows"]) for r in groups.groupBy("early").agg(F.count("*").alias("digests"), F.sum("n").alias("rows")).collect()}
    segments = max([1, *(-(-d // SEGMENT) for d, _ in sizes.values())])
    index = build_index(groups.filter("early").drop("early"), segments)
    merged = stored(merge_batch(index, groups.filter("not early").drop("early"), segments), "merged-groups")
    joined = join_large_groups(rows.drop("early"), merged, "digest", "n", sum(r for _, r in sizes.values()))
    return joined.select(
        "doc_id", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), "digest", "in_history"
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without repeats: one row of each group of equal texts, all columns as they were."""
    digest, first, winner, won = free_names(docs, "digest", "first", "winner", "won")
    winners = exact_dedup(docs, None, id_column, text_column).filter("kept").select(F.col("doc_id").alias(winner), F.col("digest").alias(won)).distinct()
    keyed = with_digest(docs, digest, text_column)
    same = F.col(digest).eqNullSafe(F.col(won)) & col(id_column).eqNullSafe(F.col(winner))
    place = F.row_number().over(Window.partitionBy(col(id_column), F.col(digest)).orderBy(F.lit(1)))
    return keyed.join(winners, same, "left_semi").withColumn(first, place).filter(F.col(first) == 1).select(*[col(c) for c in docs.columns])
