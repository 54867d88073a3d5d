"""Byte-level BPE over a corpus through a shuffle of distinct words.

Texts are split into pre-tokens with their positions. Each block of documents lists its distinct words and
keeps every position as a number of its list. The words, dealt by their hash, meet those of all other blocks;
each distinct word is encoded once, and its ids travel back to the blocks that asked, where the documents are
put together again by position. What is shuffled is a block's word list and its positions, both packed, rather
than a row for each of the corpus's tokens. Decoding looks up each id in the table of token bytes, whose size is the vocabulary's.

The documents are read twice: for the word lists and for the positions. A block is named by a digest of its
word list and its documents' ids. Documents that do not come straight from files may read differently the second time; they are written once
first. Should blocks differ all the same, no list fits and the job fails rather than give wrong ids.

Null text is the empty text, which has no ids. Repeated rows and ids are encoded as often as they occur. An
empty table gives no rows. Other columns are not read. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.values import col
from flowsieve.llm.tables import filled, id_text, id_type, sliced, stored

BLOCK_CHARACTERS = 6_000_000
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
# What may stand between the files and the documents so that both readings give the same rows in the same order.
SAME_AGAIN = {"Project", "Filter", "Relation", "LogicalRelation", "LocalRelation", "LogicalRDD"}


# --- packed columns


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, as high planes are mostly zero."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zlib.compress(planes.tobytes(), 1)


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    return len(sizes := pack_numbers(np.fromiter(map(len, words), dtype=np.uint32, count=len(words)))).to_bytes(4, "little") + sizes + zlib.compress(b"".join(words), 1)


def unpack_words(packed: bytes) -> list[bytes]:
    n = int.from_bytes(packed[:4], "little")
    ends = np.cumsum(unpack_numbers(packed[4 : 4 + n]), dtype=np.int64).tolist()
    data = zlib.decompress(packed[4 + n :])
    return [data[a:b] for a, b in zip([0, *ends], ends)]


# --- blocks


class Numbers(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[bytes, pa.Array, list[np.ndarray], list[bytes]]]:
    """Name, ids of documents, positions of each as word numbers, and words, for runs of documents up to `BLOCK_CHARACTERS`."""
    find = regex.compile(pattern).findall
    numbers, sequences, owners, size = Numbers(), [], [], 0

    def finish() -> tuple[bytes, pa.Array, list[np.ndarray], list[bytes]]:
        name = hashlib.blake2b(repr([o.to_pylist() for o in owners]).encode(), digest_size=16)
        name.update("\0".join(numbers).encode())
        return name.digest(), pa.concat_arrays(owners), sequences, [w.encode() for w in numbers]

    for batch in sliced(batches):
        texts, first = filled(batch.column("text")), 0
        for i, value in enumerate(texts):
            text = value.as_py()
            if sequences and size + len(text) > BLOCK_CHARACTERS:
                owners.append(batch.column("doc_id").slice(first, i - first))
                yield finish()
                numbers, sequences, owners, size, first = Numbers(), [], [], 0, i
            tokens = find(text)
            sequences.append(np.fromiter(map(numbers.__getitem__, tokens), dtype=np.uint32, count=len(tokens)))
            size += len(text)
        owners.append(batch.column("doc_id").slice(first))
    if sequences:
        yield finish()


def buckets_of(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) % np.uint32(buckets)


def word_lists(plain: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """The distinct words of each block by bucket: block, bucket, words (packed, in the order of their numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, words in blocks(batches, pattern):
            bucket = buckets_of(words, buckets)
            order = np.argsort(bucket, kind="stable")
            present, starts = np.unique(bucket[order], return_index=True)
            ends = [*starts[1:].tolist(), len(order)]
            lists = [pack_words([words[i] for i in order[a:b]]) for a, b in zip(starts.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(lists), pa.binary()), pa.array(present.astype(np.int64)), pa.array(lists, pa.binary())], names=["block", "bucket", "words"])

    return plain.mapInArrow(run, "block binary, bucket bigint, words binary")


def positions(plain: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """One row per block: block, doc_ids, sizes (positions of each document), positions (packed) and the bucket of each word (packed)."""
    kind = id_type(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, owners, sequences, words in blocks(batches, pattern):
            whole = np.concatenate(sequences) if sequences else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners), pa.array([[len(s) for s in sequences]], pa.list_(pa.int64())),
                    pa.array([pack_numbers(whole)], pa.binary()), pa.array([pack_numbers(buckets_of(words, buckets))], pa.binary()),
                ],
                names=["block", "doc_ids", "sizes", "positions", "buckets"],
            )

    return plain.mapInArrow(run, f"block binary, doc_ids array<{kind}>, sizes array<bigint>, positions binary, buckets binary")


# --- encoding


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """Built once in a worker."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})


def encode_words(lists: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Each distinct word of a bucket encoded once; block, bucket, sizes and ids of its words (packed).

    The lists of a bucket come one after the other, so that a task holds a bucket's words and one batch of lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern).encode_ordinary
        known: dict[bytes, list[int]] = {}
        here, last = None, None
        for batch in batches:
            kept, sizes, ids = [], [], []
            for i, (bucket, block) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist())):
                if bucket != here:
                    known, here, last = {}, bucket, None
                if block == last:  # repeated rows may give a block twice
                    continue
                last, found = block, []
                for word in unpack_words(batch.column("words")[i].as_py()):
                    if word not in known:
                        known[word] = encode(word.decode())
                    found.append(known[word])
                kept.append(i)
                sizes.append(pack_numbers(np.fromiter(map(len, found), dtype=np.uint32, count=len(found))))
                ids.append(pack_numbers(np.array([i for f in found for i in f], dtype=np.uint32)))
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("block").take(at), batch.column("bucket").take(at), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["block", "bucket", "sizes", "ids"])

    in_order = lists.repartition("bucket").sortWithinPartitions("bucket", "block")
    return in_order.mapInArrow(run, "block binary, bucket bigint, sizes binary, ids binary")


@dataclass(frozen=True)
class IdLists:
    """What is returned of each document: its ids. Subclasses turn the lists into other columns where they are made."""

    schema = "ids array<int>"

    def columns(self, ids: pa.Array) -> dict[str, pa.Array]:
        return {"ids": ids}


def reassemble(placed: DataFrame, encoded: DataFrame, kind: str, result: IdLists) -> DataFrame:
    """doc_id and the result's columns for every document, from its block's positions and the ids of its block's words."""

    def run(own: pa.Table, lists: pa.Table) -> pa.Table:
        out = []
        bucket = None
        for row in own.select(["positions", "buckets", "sizes"]).to_pylist():  # blocks of repeated rows share a name
            if bucket is None:
                bucket = unpack_numbers(row["buckets"])
                by_bucket = {r["bucket"]: r for r in lists.to_pylist()}
                present = np.unique(bucket).tolist()
                if any(b not in by_bucket for b in present):
                    raise ValueError("the documents were not the same when read again; store them first")
                sizes = np.concatenate([unpack_numbers(by_bucket[b]["sizes"]) for b in present] or [np.zeros(0, np.uint32)])
                ids = np.concatenate([unpack_numbers(by_bucket[b]["ids"]) for b in present] or [np.zeros(0, np.uint32)])
                order = np.argsort(bucket, kind="stable")  # the lists' words, as numbers
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.astype(np.int32)))
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                n_ids = sizes[place].astype(np.int64)
            at = unpack_numbers(row["positions"])
            ends = np.concatenate([[0], np.cumsum(n_ids[at])])[np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)]
            out.append((ends, words.take(pa.array(place[at])).flatten()))
        arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat) for ends, flat in out]
        owners = [x.values for x in own["doc_ids"]]
        if not own.num_rows:
            raise ValueError("the documents were not the same when read again; store them first")
        return pa.table({"doc_id": pa.concat_arrays(owners), **result.columns(pa.concat_arrays(arrays))})

    return placed.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(run, f"doc_id {kind}, {result.schema}")


def reads_alike(docs: DataFrame) -> bool:
    """Whether the documents come straight from files, so that each reading gives the same rows in the same order."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m.group() for line in plan.splitlines() if (m := re.search(r"[A-Za-z]+", line))}
    return nodes <= SAME_AGAIN and not re.search(r"\b(rand|randn|uuid|shuffle|monotonically_increasing_id)\(", plan)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", result: IdLists = IdLists()) -> DataFrame:
    """One row per document: doc_id and ids, as the rank file's encoder gives them without special tokens, or what `result` makes of them."""
    plain = id_text(docs, id_column, text_column)
    if not reads_alike(plain):
        plain = stored(plain, "bpe-documents")
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 2 * plain.rdd.getNumPartitions()))
    encoded = encode_words(word_lists(plain, pattern, buckets), ranks_path, pattern)
    return reassemble(positions(plain, pattern, buckets), encoded, id_type(plain), result)


# --- ids to bytes


def joined_values(ids: pa.Array, table: pa.Array) -> Iterator[memoryview]:
    """For each list of ids, the table's values for them, one after the other."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    for one in ids:
        taken = table.take(one.values) if one.is_valid else table.slice(0, 0)
        _, offsets, data = taken.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1] if offsets is not None and len(taken) else [0, 0]
        yield memoryview(data)[bounds[0] : bounds[-1]] if data is not None else memoryview(b"")


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> pa.Array:
    """The table of token bytes by id."""
    ranks = read_ranks(ranks_path)
    values = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        values[rank] = token
    return pa.array(values, pa.large_binary())


def bpe_decode(ids: str, ranks_path: str) -> Column:
    """The bytes of a column of id lists; null is no ids."""
    return F.arrow_udf(lambda lists: pa.array([bytes(v) for v in joined_values(lists, token_bytes(ranks_path))], pa.binary()), "binary")(col(ids))


@lru_cache(maxsize=2)
def decimals(vocabulary: int) -> pa.Array:
    return pa.array([b"%d," % i for i in range(vocabulary)], pa.large_binary())


@dataclass(frozen=True)
class RoundTrip(IdLists):
    """Number of ids, SHA-256 of the ids in decimal joined by commas, and SHA-256 of the bytes that they decode to."""

    ranks_path: str
    vocabulary: int
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def columns(self, ids: pa.Array) -> dict[str, pa.Array]:
        written = [hashlib.sha256(v[:-1] if len(v) else v).hexdigest() for v in joined_values(ids, decimals(self.vocabulary))]
        decoded = [hashlib.sha256(v).hexdigest() for v in joined_values(ids, token_bytes(self.ranks_path))]
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array(written, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
