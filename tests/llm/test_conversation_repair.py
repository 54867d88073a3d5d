"""Conversation repair against a version that knows no spans: the cheapest path over rows and output states, by a heap."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from flowsieve.llm import conversation_repair as repair
from flowsieve.llm.queries import op11_conversation_repair
from flowsieve.queries.registry import table
from llm.samples import frame, rows_of

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SF = "/root/testdata/sf0.01"


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def cheapest(rows, must, broken):
    """The least (cost, audit), and the repaired rows, of one conversation: paths over (row, what is written so far)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in set(follows) & set("ua"):
            full = {"u": "user", "a": "assistant"}[role]
            heapq.heappush(heap, (cost + 5, audit + "I", i, role, (*out, (full, ""))))
            if i < len(rows) and not must[i]:
                heapq.heappush(heap, (cost + 1 + 5 * broken[i], audit + "R", i + 1, role, (*out, (full, rows[i][1]))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if not must[i] and rows[i][0][:1] and rows[i][0][0] in follows:
                heapq.heappush(heap, (cost + 5 * broken[i], audit + "K", i + 1, rows[i][0][0], (*out, rows[i])))
    raise AssertionError


def by_hand(rows):
    expected = []
    ordered = sorted(damage(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    for conv_id in {r[0] for r in rows}:
        own = [r for r in ordered if r[0] == conv_id]
        said, seen, must, broken, counts = [r[2:] for r in own], set(), [], [], [0, 0, 0]
        for role, text in said:
            end = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            kind = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                counts[kind] += 1
            must.append(kind in (0, 1)), broken.append(kind == 2)
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit, out = cheapest(said, must, broken)
        expected.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()))
    return sorted(expected, key=repr)


def found(spark, rows, tmp_path):
    path = str(tmp_path / "sf")
    odd = frame(spark, rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("n", "first", "digest", "part", "audit", "cells", "position", "body", "blank")})
    odd.write.parquet(f"{path}/conversations.parquet")
    return rows_of(driver.queries()["op11_conversation_repair"](spark, path), *RESULT)


def chat(seed, conv_id, n):
    draw = random.Random(seed)
    role = lambda: draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User", "söö", "a"])
    text = lambda: draw.choice(["", " \n", "Yes.", "No", "why?", "A  ", "long! \t", f"{draw.random()}.", f"{draw.random()}"])
    return [(conv_id, draw.choice([None, t, t, t, t // 2]) if n < 40 else t, role(), text()) for t in range(n)]


ODD = [
    (None, None, None, None), (None, 3, "user", "a."), (None, 4, "assistant", "b."), (1, None, "user", "x"), (1, None, "user", "x"), (1, 5, None, "y."), (2, 7, "user", None),
    (3, -(1 << 63), "user", "a."), (3, (1 << 63) - 2, "assistant", "b."), (4, 1, "system", "w. " * 100_000), (4, 2, "user", "w" * 300_000 + "!"), (4, 3, "assistant", "ok."),
]


@pytest.mark.parametrize("rows", [[], ODD, [r for i in range(60) for r in chat(i, i, i % 13)]])
def test_small_tables(spark, tmp_path, rows):
    expected = [(r[0], min(r[1], (1 << 63) - 1), *r[2:]) for r in by_hand(rows)]
    assert found(spark, rows, tmp_path) == expected


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op11_conversation_repair(spark, SF), *RESULT) == by_hand(rows)


def test_one_conversation_over_all_tasks(spark, tmp_path):
    """Half of all rows in one conversation, many of them equal; its pieces are combined over several rounds."""
    rows = [r for i in range(40) for r in chat(i, i, 8)] + chat(99, 7_000, 300) + [(7_000, 400, "user", "same.")] * 50 + [(7_000, t, "user", "same.") for t in range(500, 540)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        assert found(spark, rows, tmp_path) == by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def every_split(symbols):
    """Cells by all places to divide each span."""
    table_, n = {}, len(symbols)
    for length in range(1, n + 1):
        for i in range(n - length + 1):
            j = i + length
            options = [repair.combine(table_[i, k], table_[k, j]) for k in range(i + 1, j)] if length > 1 else [repair.row_cells(symbols[i])]
            table_[i, j] = tuple(min(cells) for cells in zip(*options))
    return table_[0, n] if n else repair.NOTHING


def test_one_division_is_as_good_as_all():
    draw = random.Random(5)
    for n in [0, 1, 2, 3, *(draw.randrange(4, 20) for _ in range(60))]:
        symbols = "".join(draw.choices("xsuaoSUAO", k=n))
        spans = repair.Spans()
        for s in symbols:
            spans.add(s, 1)
        assert spans.cells() == repair.span_cells(symbols) == every_split(symbols)


def test_equal_rows_by_doubling():
    for n in (0, 1, 8, 9, 37, 64):
        assert repair.repeated("x", n) == every_split("x" * n)
        spans = repair.Spans()
        spans.add("u", 1), spans.add("x", n), spans.add("a", 1)
        assert spans.cells() == repair.span_cells("u" + "x" * n + "a")


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Lone."), (3, 0, "user", " ")]
    conversations = frame(spark, rows, SCHEMA)
    audits = repair.diagnosed(conversations)
    assert rows_of(audits, "conv_id", "cost", "audit") == [(1, 2, "KDK"), (2, 2, "D"), (3, 2, "D")]
    assert rows_of(repair.repaired(conversations, audits), "conv_id", "position", "turn", "role", "text", "edit") == [(1, 0, 0, "user", "Hi.", "K"), (1, 1, 2, "assistant", "Yes.", "K")]
