"""Cost-balanced packing: sequences of at most `capacity` tokens with little padding and even attention cost.

The cost of a piece of n tokens is estimated as `LINEAR` * n + n * n: a part for every token, and attention's part
for every pair of tokens of a piece. Documents in descending length go to the sequence of the lowest cost so far that still
has room for the whole document. Where no sequence has, the lowest-cost one with any room takes a beginning of
it, and the rest is dealt again by its own length. As documents may be cut, no padding is needed: there are as many full
sequences as the tokens fill, and one sequence for each power of two in what is left over.

The plan is made on the histogram of lengths, many equal documents and many equal sequences at a time, so only one number for
each length reaches the driver. A plan is a table of ranges: the units of a length with ranks [first, last) put their tokens
from `cut` on, `taken` of them, into consecutive sequences at `offset`. Each task numbers its units of each
length while it tokenises, and the numbers of tasks are added up by length, so that ranks need no sort and no group of equal
lengths meets in one task.

A document longer than `capacity` gives full units and a last one with what is left. Token ids are kept as the narrowest
whole numbers that hold the vocabulary and are read again only for units that are cut.

Null text is the empty text: its end token alone. Very long texts are tokenised whole. Repeated rows are packed as often as they
occur; ties of length are in order of storage. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.tables import BROADCAST_ROWS
from flowsieve.llm.packing import Byte50k, plan_table
from flowsieve.llm.tables import filled, id_text, id_type, sliced, stored

CAPACITY, END, VOCABULARY = 1024, 0, 50_257
LINEAR = 4096
RANGE_FIELDS = ["unit_length", "first", "last", "cut", "taken", "sequence", "offset"]


# --- units: documents as tokens, in parts of one sequence's length at most


@lru_cache(maxsize=1)
def encoder(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...]) -> Byte50k:
    """One encoder for all tasks of a worker."""
    return Byte50k(ranks_path, pattern, dict(added))


def units(docs: DataFrame, tokenizer_files: tuple[str, str, dict], capacity: int, end: int, id_column: str, text_column: str, vocabulary: int) -> DataFrame:
    """doc_id, doc_tokens, start, unit_length, unit_crc32, ids, and the unit's number `place` among those of its length in the task `part`."""
    narrow = "<u2" if vocabulary <= 1 << 16 else "<u4"
    ranks_path, pattern, added = tokenizer_files[0], tokenizer_files[1], tuple(tokenizer_files[2].items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(ranks_path, pattern, added), Counter(), TaskContext.get().partitionId()
        for batch in sliced(batches):
            owner, kept, columns = [], [], [[] for _ in range(5)]
            for i, text in enumerate(filled(batch.column("text"))):
                ids = np.append(encode(text.as_py()), np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    unit = ids[start : start + capacity]
                    for values, value in zip(columns, (len(ids), start, len(unit), zlib.crc32(unit.tobytes()), seen[len(unit)])):
                        values.append(value)
                    seen[len(unit)] += 1
                    owner.append(i), kept.append(unit.astype(narrow).tobytes())
            numbers = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), *numbers, pa.array([part] * len(owner), pa.int32()), pa.array(kept, pa.binary())],
                names=["doc_id", "doc_tokens", "start", "unit_length", "unit_crc32", "place", "part", "ids"],
            )

    plain = id_text(docs, id_column, text_column)
    schema = f"doc_id {id_type(plain)}, doc_tokens bigint, start bigint, unit_length bigint, unit_crc32 bigint, place bigint, part int, ids binary"
    return plain.mapInArrow(run, schema)


# --- the plan


def capacities(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(size, how many) of the sequences that hold so many tokens without padding."""
    full, rest = divmod(tokens, capacity)
    return [(size, n) for size, n in [(capacity, full), *((1 << b, rest >> b & 1) for b in reversed(range(capacity.bit_length())))] if n]


def cost(length: int) -> int:
    return LINEAR * length + length * length


def balanced_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Ranges (unit_length, first, last, cut, taken, sequence, offset) from the number of units of each length.

    Sequences of equal cost and room are one run, in a heap by cost for each room; units of equal remaining length are runs
    of ranks, in a heap by length. A step takes the longest units and the cheapest sequences and uses up one of the two runs,
    so there are about as many steps as lengths and splits of runs, whatever the number of units.
    """
    plan: list[tuple[int, ...]] = []
    open_runs: dict[int, list[tuple[int, int, int, int]]] = {}  # room: heap of (cost, first sequence, how many, filled)
    rooms: list[int] = []

    def put(room: int, run: tuple[int, int, int, int]) -> None:
        if not room:
            return
        if room not in open_runs:
            open_runs[room] = []
            insort(rooms, room)
        heapq.heappush(open_runs[room], run)

    def take(least: int) -> tuple[int, tuple[int, int, int, int]] | None:
        """The cheapest run with room for so many tokens; of equal cost the one with the least room."""
        fitting = rooms[bisect_left(rooms, least) :]
        if not fitting:
            return None
        room = min(fitting, key=lambda r: open_runs[r][0][0])
        run = heapq.heappop(open_runs[room])
        if not open_runs[room]:
            del open_runs[room], rooms[bisect_left(rooms, room)]
        return room, run

    opened = 0
    for size, n in capacities(sum(length * n for length, n in histogram.items()), capacity):
        put(size, (0, opened, n, 0))
        opened += n
    waiting = [(-length, length, 0, n, 0) for length, n in histogram.items() if n]  # remaining, unit length, first rank, how many, cut
    heapq.heapify(waiting)
    while waiting:
        remaining, length, first, n, at = heapq.heappop(waiting)
        room, (spent, sequence, copies, offset) = take(-remaining) or take(1)
        taken, used = min(-remaining, room), min(n, copies)
        plan.append((length, first, first + used, at, taken, sequence, offset))
        put(room - taken, (spent + cost(taken), sequence, used, offset + taken))
        if used < copies:
            put(room, (spent, sequence + used, copies - used, offset))
        if taken < -remaining:
            heapq.heappush(waiting, (remaining + taken, length, first, used, at + taken))
        if used < n:
            heapq.heappush(waiting, (remaining, length, first + used, n - used, at))
    return plan


# --- the operator


def ranked(cut_units: DataFrame) -> DataFrame:
    """The units with their rank within their length: the task's own number after those of the tasks before it."""
    counts = cut_units.groupBy("unit_length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("unit_length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("unit_length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    return cut_units.join(starts, ["unit_length", "part"]).withColumn("rank", F.col("before") + F.col("place")).drop("before")


def balanced_pack(
    docs: DataFrame, tokenizer_files: tuple[str, str, dict], capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", text_column: str = "text",
    vocabulary: int = VOCABULARY,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every id is in exactly one piece."""
    cut_units = stored(units(docs, tokenizer_files, capacity, end, id_column, text_column, vocabulary), "balanced-units")
    histogram = {r["unit_length"]: r["n"] for r in cut_units.groupBy("unit_length").agg(F.count("*").alias("n")).collect()}
    plan = balanced_plan(histogram, capacity)
    ranges = plan_table(docs, plan, RANGE_FIELDS)
    ranges = F.broadcast(ranges) if len(plan) <= BROADCAST_ROWS else ranges
    placed = ranked(cut_units.drop("ids")).join(ranges, "unit_length").filter((F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("last")))
    placed = stored(
        placed.select(
            "doc_id", "doc_tokens", "start", "unit_length", "unit_crc32", "part", "place", "cut", "taken", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
        ),
        "balanced-pieces",
    )
    whole = placed.filter("taken = unit_length").withColumn("ids_crc32", F.col("unit_crc32"))
    key = ["part", "unit_length", "place"]
    parts = placed.filter("taken < unit_length").join(cut_units.select(*key, "ids"), key)
    parts = parts.withColumn("ids_crc32", crc32_of_slice(vocabulary)).drop("ids")
    return whole.unionByName(parts).select(
        "doc_id", (F.col("start") + F.col("cut")).alias("start"), F.col("taken").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def crc32_of_slice(vocabulary: int):
    """The sum of ids `cut` to `cut + taken` as 32-bit numbers, from the narrow ones."""
    width = 2 if vocabulary <= 1 << 16 else 4
    part = F.substring("ids", (F.col("cut") * width + 1).cast("int"), (F.col("taken") * width).cast("int"))
    if width == 4:
        return F.crc32(part)
    # Two zero bytes after each number, in hexadecimal digits.
    return F.crc32(F.unhex(F.regexp_replace(F.hex(part), "(....)", "$10000")))
