"""Repair of conversation structure by weighted interval parsing (CYK).

A repaired conversation is `(s?(ua)+)?` in its roles' initials. The grammar is in Chomsky normal form: a nonterminal <p,q> takes the roles
read so far from state p to state q; <p,q> -> <p,r> <r,q> joins neighbouring spans, and <p,q> -> row is a row that is kept
(0), given the role user or assistant (1), or deleted (2, the only edit of blank and repeated rows). A row whose text breaks
off costs 5 more unless it is deleted. Insertions (5 each) need no row: the cells of one row are closed under insertions before
and after it, so that longer spans need no rule for them. A span's cell for <p,q> is its least (cost, audit): audits are the edits'
initials, compared bytewise. Of the same span and states, no audit of equal cost is the beginning of another, as the rest of it would be
insertions; so the least one of a span is made of the least ones of its parts. And as <p,q> -> <p,r> <r,q> holds for every r, each
place to divide a span gives the same cells: one division for each span is enough, and spans are combined bottom-up by length
(one row, two, four, ...) instead of at all their places.

Rows stand in order of turn (nulls first), role, and digest of the text. A range partitioning by conversation and this order
spreads a conversation of any length over tasks; each gives the cells of its rows, and only those that meet at the borders of
tasks are combined again, 64 tasks at a time. Equal rows are counted, not repeated. Which row of equal role and text comes first is
found by aggregates that do not gather a conversation. Texts are not moved for this. The repaired rows come from one
pass in order, whose memory is one audit and one batch; the digest of a conversation is sequential by definition.

Null in role or text is one space; a null conversation is one of its own. A text without anything but blanks is blank; of equal rows of one turn the
first is the original. Very long texts are hashed whole. Gaps beyond a 64-bit number are given as the greatest one. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from flowsieve.functions.values import col
from flowsieve.llm.tables import id_type, stored

BLANKS = " \t\n\x0b\x0c\r"
RELABEL, DELETE, BROKEN, INSERT = 1, 2, 5, 5

# --- the grammar: states after the roles read so far, and the roles that lead on

START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
GIVEN = {p: (role, q) for (p, role), q in STEP.items() if role != "s"}  # what an inserted or relabelled row becomes
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
WIDTH, BLOCK = 64, 8

Cell = tuple[int, str]


def insertions(p: int) -> dict[int, int]:
    """The fewest insertions from a state to each state."""
    found, steps = {p: 0}, 0
    while GIVEN[p][1] not in found:
        p, steps = GIVEN[p][1], steps + 1
        found[p] = steps
    return found


CLOSURE = {p: insertions(p) for p in range(4)}
REACHED = {p: {q for q in range(4) if q in CLOSURE[p] or q in {t for (s, _), t in STEP.items() if s == p}} for p in range(4)}
PAIRS = [(p, q) for p in range(4) for q in sorted(REACHED[p])]
NUMBER = {pair: i for i, pair in enumerate(PAIRS)}
RULES = [[(NUMBER[p, r], NUMBER[r, q]) for r in range(4) if (p, r) in NUMBER and (r, q) in NUMBER] for p, q in PAIRS]
NOTHING = tuple((INSERT * CLOSURE[p][q], "I" * CLOSURE[p][q]) if q in CLOSURE[p] else (NEVER, "") for p, q in PAIRS)


def combine(left: tuple[Cell, ...], right: tuple[Cell, ...]) -> tuple[Cell, ...]:
    """The cells of two neighbouring spans as one."""
    cells = []
    for rules in RULES:
        least, audits = NEVER, []
        for i, j in rules:
            cost = left[i][0] + right[j][0]
            if cost < least:
                least, audits = cost, [(i, j)]
            elif cost == least:
                audits.append((i, j))
        cells.append((least, min((left[i][1] + right[j][1] for i, j in audits), default="") if least < NEVER else ""))
    return tuple(cells)


def row_cells(symbol: str) -> tuple[Cell, ...]:
    """The cells of one row: `x` must go, s, u, a and o (any other) are roles, in capitals if the text breaks off."""
    edits: dict[tuple[int, int], list[Cell]] = {(p, p): [(DELETE, "D")] for p in range(4)}
    if symbol != "x":
        more = BROKEN if symbol.isupper() else 0
        for p in range(4):
            if (p, symbol.lower()) in STEP:
                edits.setdefault((p, STEP[p, symbol.lower()]), []).append((more, "K"))
            edits.setdefault((p, GIVEN[p][1]), []).append((RELABEL + more, "R"))
    alone = tuple(min(edits.get(pair, [(NEVER, "")])) for pair in PAIRS)
    return combine(combine(NOTHING, alone), NOTHING)


@lru_cache(maxsize=1 << 16)
def span_cells(symbols: str) -> tuple[Cell, ...]:
    if len(symbols) < 2:
        return row_cells(symbols) if symbols else NOTHING
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return combine(span_cells(symbols[:half]), span_cells(symbols[half:]))


def repeated(symbol: str, n: int) -> tuple[Cell, ...]:
    """The cells of n equal rows, by doubling."""
    if n <= BLOCK:
        return span_cells(symbol * n)
    half = repeated(symbol, n // 2)
    return combine(combine(half, half), span_cells(symbol * (n % 2)))


class Spans:
    """The cells of rows that come one after the other: spans of equal length are combined as soon as there are two."""

    def __init__(self) -> None:
        self.symbols, self.stack = "", []

    def add(self, symbol: str, n: int) -> None:
        if n > BLOCK:
            self.flush()
            self.push(n.bit_length(), repeated(symbol, n))
            return
        self.symbols += symbol * n
        while len(self.symbols) >= BLOCK:
            self.push(BLOCK.bit_length(), span_cells(self.symbols[:BLOCK]))
            self.symbols = self.symbols[BLOCK:]

    def flush(self) -> None:
        if self.symbols:
            self.push(len(self.symbols).bit_length(), span_cells(self.symbols))
            self.symbols = ""

    def push(self, level: int, cells: tuple[Cell, ...]) -> None:
        while self.stack and self.stack[-1][0] <= level:
            before, left = self.stack.pop()
            level, cells = max(level, before) + 1, combine(left, cells)
        self.stack.append((level, cells))

    def cells(self) -> tuple[Cell, ...]:
        self.flush()
        return reduce(lambda right, left: combine(left, right), [cells for _, cells in reversed(self.stack)], NOTHING)


# --- rows as symbols


def filled_rows(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """conv_id, turn, role, text under fixed names, without nulls in the last two."""
    space = F.lit(" ")
    texts = [F.coalesce(col(names[c]).cast("string"), space).alias(c) for c in ("role", "text")]
    return rows.select(col(names["conv_id"]).alias("conv_id"), col(names["turn"]).cast("bigint").alias("turn"), *texts).withColumn("digest", F.unhex(F.sha2("text", 256)))


def end_of_text(text: str) -> Column:
    """The text without blanks at its end; empty if it is blank."""
    return F.rtrim(F.col(text), F.lit(BLANKS))


def symbols_of(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number `n`, whether the first of them is the first of its role and text, and its symbol's parts."""
    end = end_of_text("text")
    key = ["conv_id", "turn", "role", "digest"]
    facts = rows.select(*key, (F.length(end) == 0).alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("broken"))
    distinct = stored(facts.groupBy(*key, "blank", "broken").agg(F.count("*").alias("n")), "conversation-rows")
    least = F.when(~F.bool_or(F.col("turn").isNull()), F.min("turn")).alias("turn")
    firsts = distinct.groupBy("conv_id", "role", "digest").agg(least).select(*key, F.lit(False).alias("blank"), F.lit(False).alias("broken"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("first"))
    marked = distinct.withColumn("first", F.lit(False)).unionByName(firsts)
    return marked.groupBy(*key).agg(F.sum("n").alias("n"), F.bool_or("first").alias("first"), F.bool_or("blank").alias("blank"), F.bool_or("broken").alias("broken"))


# --- pieces: the rows of a conversation in one task


COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal")
PIECE = (
    "part int, edge boolean, low bigint, high bigint, head string, tail string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", cells array<struct<cost: bigint, audit: string>>"
)


def legal(left: str, right: str) -> bool:
    return left + right in LEGAL


class Piece:
    """Counts and cells of the rows of one conversation, in order."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.low, self.high, self.head, self.tail, self.spans = conv_id, None, None, None, None, Spans()
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, initial: str, n: int, first: bool, blank: bool, broken: bool) -> None:
        if turn is not None:
            self.counts["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.head is None:
            self.head = initial
        else:
            self.counts["illegal"] += not legal(self.tail, initial)
        self.counts["illegal"] += 0 if legal(initial, initial) else n - 1
        self.tail = initial
        if blank:
            self.counts["blank"] += n
            self.spans.add("x", n)
            return
        self.counts["duplicate"] += n - first
        self.counts["truncated"] += first and broken
        if first:
            symbol = initial if initial in ("s", "u", "a") else "o"
            self.spans.add(symbol.upper() if broken else symbol, 1)
        self.spans.add("x", n - first)

    def record(self, part: int, edge: bool) -> dict:
        cells = [{"cost": cost, "audit": audit} for cost, audit in self.spans.cells()]
        return {"conv_id": self.conv_id, "part": part, "edge": edge, "low": self.low, "high": self.high, "head": self.head, "tail": self.tail, **self.counts, "cells": cells}


def joined(left: dict, right: dict) -> dict:
    """Two records of neighbouring pieces as one."""
    counts = {c: left[c] + right[c] for c in COUNTS}
    counts["turns"] -= left["high"] is not None and left["high"] == right["low"]
    counts["illegal"] += not legal(left["tail"], right["head"])
    sides = [tuple((c["cost"], c["audit"]) for c in side["cells"]) for side in (left, right)]
    return left | counts | {
        "low": right["low"] if left["low"] is None else left["low"],
        "high": left["high"] if right["high"] is None else right["high"],
        "tail": right["tail"],
        "cells": [{"cost": cost, "audit": audit} for cost, audit in combine(*sides)],
    }


def pieces_of(rows: DataFrame, conv: str) -> DataFrame:
    """One row per conversation and task; only the first and last of a task, its edges, can have parts elsewhere."""
    schema = f"conv_id {conv}, {PIECE}"
    arrow = arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "n", "first", "blank", "broken"))
            for conv_id, *row in zip(*columns):
                if piece is None or conv_id != piece.conv_id:
                    if piece is not None:
                        out.append(piece.record(part, done == 0))
                        done += 1
                    piece = Piece(conv_id)
                piece.add(*row)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if piece is not None:
            yield pa.RecordBatch.from_pylist([piece.record(part, True)], arrow)

    order = ["conv_id", "turn", "role", "digest"]
    in_order = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return in_order.withColumn("initial", F.substring("role", 1, 1)).mapInArrow(run, schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def whole(pieces: DataFrame, conv: str) -> DataFrame:
    """One row per conversation: pieces at the edges of tasks are joined in order, `WIDTH` tasks at a time."""
    schema = f"conv_id {conv}, {PIECE}"
    arrow = arrow_schema(pieces, schema)

    def run(group: pa.Table) -> pa.Table:
        records = group.sort_by("part").to_pylist()
        return pa.Table.from_pylist([reduce(joined, records) | {"part": records[0]["part"] // WIDTH}], arrow)

    edges = pieces.filter("edge")
    last = edges.agg(F.max("part")).first()[0] or 0
    while True:
        grouped = edges.withColumn("tasks", F.expr(f"part div {WIDTH}")).groupBy("conv_id", "tasks").applyInArrow(lambda group: run(group.drop_columns(["tasks"])), schema)
        edges, last = stored(grouped, "conversation-edges"), last // WIDTH
        if not last:
            return pieces.filter("not edge").unionByName(edges)


# --- the operator

NAMED = {c: c for c in ("conv_id", "turn", "role", "text")}


def diagnosed(rows: DataFrame, names: dict[str, str] = NAMED) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit, a row for each conversation."""
    plain = filled_rows(rows, names)
    conv = id_type(plain, "conv_id")
    found = whole(stored(pieces_of(stored(symbols_of(plain), "conversation-symbols"), conv), "conversation-pieces"), conv)
    best = F.array_min(F.array(*[F.col("cells")[NUMBER[START, q]] for q in FINAL]))
    wide = F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("turns")
    gaps = F.when(F.col("high").isNull(), 0).otherwise(F.least(wide, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("bigint"))
    return found.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


def repaired(rows: DataFrame, audits: DataFrame, names: dict[str, str] = NAMED) -> DataFrame:
    """The conversations after their edits: conv_id, position (from 0), turn (null if inserted), role, text and edit (K, R or I).

    `audits` has conv_id and audit. Rows of a conversation are in one partition and in order.
    """
    plain = filled_rows(rows, names)
    conv = id_type(plain, "conv_id")
    schema = f"conv_id {conv}, position bigint, turn bigint, role string, text string, edit string"
    arrow = arrow_schema(plain, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, audit, at, state, position = None, "", 0, START, 0
        out: list[tuple] = []

        def put(turn: int | None, role: str | None, text: str, edit: str) -> None:
            nonlocal state, position
            given, after = GIVEN[state]
            state = STEP[state, role[0]] if edit == "K" else after
            out.append((conv_id, position, turn, role if edit == "K" else NAMES[given], text, edit))
            position += 1

        def insert() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put(None, None, "", "I")
                at += 1

        for batch in batches:
            for owner, text_of_audit, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "turn", "role", "text"))):
                if text_of_audit is not None:
                    insert()
                    conv_id, audit, at, state, position = owner, text_of_audit, 0, START, 0
                    continue
                insert()
                if audit[at] != "D":
                    put(turn, role, text, audit[at])
                at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                out.clear()
        insert()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    heads = audits.select("conv_id", F.lit(0).alias("body"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("text", "string"), ("digest", "binary"))])
    bodies = plain.select("conv_id", F.lit(1).alias("body"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "digest")
    in_order = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "body", "turn", "role", "digest")
    return in_order.select("conv_id", "audit", "turn", "role", "text").mapInArrow(run, schema)


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of `role:text` of its rows, joined by newlines, from rows as `repaired` leaves them."""
    schema = f"conv_id {id_type(conversations, 'conv_id')}, sha256 string"
    arrow = arrow_schema(conversations, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, state = None, None
        for batch in batches:
            done = []
            for owner, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if state is not None:
                        done.append({"conv_id": conv_id, "sha256": state.hexdigest()})
                    conv_id, state = owner, hashlib.sha256()
                state.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "sha256": state.hexdigest()}], arrow)

    return conversations.mapInArrow(run, schema)
