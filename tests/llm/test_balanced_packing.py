"""Cost-balanced packing: whole documents found again in the sequences, no padding, and a plan like the plain greedy one."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as driver
from flowsieve.llm import balanced_packing as packing
from flowsieve.llm.packing import best_fit_plan
from flowsieve.llm.queries import byte_50k_files
from flowsieve.queries.registry import table
from llm.samples import edge_docs, no_docs

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(rows, docs, capacity=1024, end=0):
    """Every id of every document in exactly one piece, sums right, sequences gapless and without padding."""
    ids = [(i, np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4")) for i, t in docs]
    sums, owed = defaultdict(Counter), defaultdict(Counter)
    by_id = defaultdict(list)
    for i, tokens in ids:
        by_id[i].append(tokens)
        owed[i, len(tokens)].update(range(len(tokens)))
    sequences = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] in {zlib.crc32(t[r["start"] : r["start"] + r["length"]].tobytes()) for t in by_id[r["doc_id"]] if len(t) == r["doc_tokens"]}
        sums[r["doc_id"], r["doc_tokens"]].update(range(r["start"], r["start"] + r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sums == owed
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        lengths.append(at)
    assert sum(lengths) == sum(len(t) for _, t in ids)
    assert Counter(lengths) == Counter(dict(packing.capacities(sum(lengths), capacity)))
    return sequences


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("capacity,vocabulary", [(1024, packing.VOCABULARY), (64, 1 << 20)])
def test_edge_cases(spark, capacity, vocabulary):
    docs = edge_docs(spark)
    packed = packing.balanced_pack(docs, byte_50k_files(), capacity=capacity, vocabulary=vocabulary)
    check_pieces(packed.collect(), pairs(docs), capacity)


def test_no_rows(spark):
    assert packing.balanced_pack(no_docs(spark), byte_50k_files()).collect() == []


def test_query(spark):
    check_pieces(driver.queries()["op13_balanced_packing"](spark, "/root/testdata/sf0.01").collect(), pairs(table(spark, "/root/testdata/sf0.01", "documents")))


def test_units_of_one_length_in_many_tasks(spark):
    """Two thirds of all documents have the same length; each is cut or placed once."""
    docs = spark.createDataFrame([(i, "a b c d e f g" if i % 3 else "x " * (i % 50)) for i in range(900)], "doc_id bigint, text string").repartition(11)
    check_pieces(packing.balanced_pack(docs, byte_50k_files(), capacity=16).collect(), pairs(docs), 16)


def plain_greedy(histogram, capacity):
    """One document and one sequence at a time; the quadratic costs of the sequences, sorted."""
    sequences, n = [], 0
    for size, copies in packing.capacities(sum(k * v for k, v in histogram.items()), capacity):
        for _ in range(copies):
            sequences.append([0, size])
    heap = [-k for k, v in histogram.items() for _ in range(v)]
    heapq.heapify(heap)
    while heap:
        length = -heapq.heappop(heap)
        fitting = [s for s in sequences if s[1] >= length] or [s for s in sequences if s[1]]
        s = min(fitting, key=lambda s: (s[0], s[1]))
        taken = min(length, s[1])
        s[0], s[1] = s[0] + packing.cost(taken), s[1] - taken
        if taken < length:
            heapq.heappush(heap, taken - length)
    return sorted(s[0] for s in sequences)


def costs_of(plan):
    spent = Counter()
    for _, first, last, _, taken, sequence, _ in plan:
        for i in range(last - first):
            spent[sequence + i] += packing.cost(taken)
    return sorted(spent.values())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 20), max_size=12))
def test_plan_covers_units_and_costs_as_one_by_one(histogram):
    plan = packing.balanced_plan(histogram, 32)
    covered = Counter()
    for length, first, last, cut, taken, _, _ in plan:
        covered.update((length, rank, at) for rank in range(first, last) for at in range(cut, cut + taken))
    assert covered == Counter((length, rank, at) for length, n in histogram.items() for rank in range(n) for at in range(length))
    assert costs_of(plan) == plain_greedy(histogram, 32)


def test_costs_are_more_even_than_by_best_fit():
    """For documents of up to half a sequence, of which no one sets a sequence's cost; they stay whole in best fit, and mostly here."""
    lengths = Counter(np.clip(np.random.default_rng(3).lognormal(4.5, 1, 20_000).astype(int), 1, 512).tolist())
    best_fit = Counter()
    for length, first, last, sequence, copies, _ in best_fit_plan(lengths):
        for i in range(first, last):
            best_fit[sequence + (i - first) // copies] += packing.cost(length)
    plan = packing.balanced_plan(lengths)
    full = sum(n * k for n, k in lengths.items()) // 1024
    even, uneven = costs_of(plan)[-full:], sorted(best_fit.values())[-full:]
    assert np.std(even) < 0.5 * np.std(uneven)
    assert sum(last - first for _, first, last, _, taken, _, _ in plan) < 1.15 * sum(lengths.values())


def test_plan_does_not_grow_with_the_rows():
    lengths = np.clip(np.random.default_rng(3).lognormal(5, 1, 20_000).astype(int), 1, 1024)
    small = Counter(lengths.tolist())
    assert len(packing.balanced_plan({k: v * 10**7 for k, v in small.items()})) < 2 * len(packing.balanced_plan(small))
