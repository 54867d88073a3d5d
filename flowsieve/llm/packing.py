"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenised once, get an end token, and are cut where they are longer than a sequence: all
pieces but the first are full. Only the number of pieces of each length reaches the driver: at most
`capacity` numbers, whatever the data. Best-fit decreasing runs over these counts: lengths in falling order,
each into the fullest sequences that still hold it, many equal sequences at a time. The plan is a table of
ranges: the pieces of a length with ranks [first, last) go to consecutive sequences, `copies` to each, at a
given offset. Pieces then learn their rank within their length and join the plan on it.

Null text is the empty text: one piece that holds the end token. Repeated rows are packed as often as they
occur; those that share id and text are interchangeable. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.tables import filled, id_text, id_type, sliced, stored

CAPACITY, END = 1024, 2
ROWS_PER_TASK = 4096
RANGE_FIELDS = ["length", "first", "last", "sequence", "copies", "start_offset"]


# --- tokens


def ranks_encoder(path: str, pattern: str, special: dict[str, int]) -> tiktoken.Encoding:
    """An encoder from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class Byte50k:
    """The ids of `byte_bpe_50k.json`: its vocabulary is also kept as ranks, which encode several times as fast.

    As in that tokenizer, the string of its one added token stands for that token wherever it occurs.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]) -> None:
        self.encoder = ranks_encoder(ranks_path, pattern, added)
        self.added = set(added)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, allowed_special=self.added), dtype="<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece; only the first may be short."""
    first = n % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_files: tuple[str, str, dict], capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Byte50k(*tokenizer_files)
        for batch in sliced(batches):
            owner, numbers, starts, lengths, sums = [], [], [], [], []
            for i, text in enumerate(filled(batch.column("text"))):
                ids = np.append(encode(text.as_py()), np.uint32(end)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    owner.append(i), numbers.append(k), starts.append(start), lengths.append(length)
                    sums.append(zlib.crc32(ids[start : start + length].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(c, pa.int64()) for c in (starts, lengths, sums))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    plain = id_text(docs, id_column, text_column)
    return plain.mapInArrow(run, f"doc_id {id_type(plain)}, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- the plan


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Ranges (length, first, last, sequence, copies, start_offset) from the number of pieces of each length.

    Open sequences are kept as runs of equal ones by the room they have left; a run is split when only a
    part of it is filled. The number of runs depends on the number of lengths, not on the number of pieces.
    """
    plan: list[tuple[int, ...]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    rooms: list[int] = []
    opened = 0

    def put(room: int, sequence: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((sequence, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                sequence, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, sequence = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            copies = min(room // length, left)
            used = min(n, left // copies)  # sequences that take `copies` pieces each; the rest of the run stays as it is
            plan.append((length, rank, rank + used * copies, sequence, copies, capacity - room))
            left, rank = left - used * copies, rank + used * copies
            put(room - copies * length, sequence, used)
            put(room, sequence + used, n - used)
    return plan


# --- the operator


def plan_table(df: DataFrame, plan: list[tuple[int, ...]], fields: list[str] = RANGE_FIELDS) -> DataFrame:
    """The plan as a table of fixed schema, through a literal: a few thousand rows at most."""
    rows = "[" + ",".join("[" + ",".join(map(str, r)) + "]" for r in plan) + "]"
    parsed = F.from_json(F.lit(rows), "array<array<bigint>>")
    one = df.sparkSession.range(1).select(F.explode(parsed).alias("r"))
    return one.select(*[F.col("r")[i].alias(name) for i, name in enumerate(fields)])


def with_rank(cut_pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """The pieces with their rank within their length, from 0.

    Each length is dealt to groups by a hash of the row, as many as its pieces need; groups are ordered by themselves and start
    where the groups before them end, so no length has to fit one task, and the table of starts stays thousands of times smaller than the pieces.
    """
    row = ["doc_id", "piece", "start", "ids_crc32"]
    groups = plan_table(cut_pieces, [(length, max(1, n // ROWS_PER_TASK)) for length, n in histogram.items()], ["length", "groups"])  # a row per length
    dealt = cut_pieces.join(F.broadcast(groups), "length").withColumn("dealt", F.pmod(F.xxhash64(*row), F.col("groups"))).drop("groups")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("length", "dealt").agg(F.count("*").alias("n")).select("length", "dealt", F.coalesce(before, F.lit(0)).alias("group_start"))
    place = F.row_number().over(Window.partitionBy("length", "dealt").orderBy(*row))
    return dealt.withColumn("place", place).join(starts, ["length", "dealt"]).withColumn("rank", F.col("group_start") + F.col("place") - 1).drop("place", "group_start", "dealt")


def pack(docs: DataFrame, tokenizer_files: tuple[str, str, dict], capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_pieces = stored(pieces(docs, tokenizer_files, capacity, end, id_column, text_column), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = F.broadcast(plan_table(docs, best_fit_plan(histogram, capacity)))
    ranked = with_rank(cut_pieces, histogram)
    planned = ranked.join(ranges, "length").filter((F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("last")))
    at = F.col("rank") - F.col("first")
    return planned.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("start_offset") + (at % F.col("copies")) * F.col("length")).cast("bigint").alias("offset"),
    )
