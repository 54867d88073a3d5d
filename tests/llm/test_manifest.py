"""The Merkle manifest against a plain version with whole levels in lists."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from flowsieve.llm import manifest
from flowsieve.queries.registry import table
from llm.samples import frame, rows_of

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return sha("".join(map(written, (doc_id, source, lang, None if n_chars is None else n_chars + more, text))))


def tree(leaves, fanout):
    """The root, and for each leaf its siblings of each level as (left, right)."""
    proofs, owners, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], leaves
    while len(level) > 1:
        for i, owner in enumerate(owners):
            start = i // fanout * fanout
            for leaf_at in owner:
                proofs[leaf_at].append(("".join(level[start:i]), "".join(level[i + 1 : start + fanout])))
        owners = [sum(owners[i : i + fanout], []) for i in range(0, len(level), fanout)]
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], proofs


def by_hand(rows, fanout=2):
    tampered = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in ordered}
    trees = {g: tree([leaf(r) for r in members[g]], fanout) for g in ordered}
    root, above = tree([trees[g][0] for g in ordered], fanout) if ordered else (None, [])
    expected = []
    for g, upper in zip(ordered, above):
        for r, own in zip(members[g], trees[g][1]):
            proof, h = own + upper, leaf(r, int(tampered(r)))
            for left, right in proof:
                h = sha(left + h + right)
            expected.append((r[0], leaf(r), trees[g][0], root, sha("".join(a + b for a, b in proof)), h, h == root))
    return sorted(expected, key=repr)


def found(docs, tmp_path):
    path = str(tmp_path / "sf")
    docs.write.parquet(f"{path}/documents.parquet")
    return rows_of(driver.queries()["op12_merkle_manifest"](docs.sparkSession, path), *RESULT)


ODD = [
    (1, "a", "en", 3, "abc"), (2, None, "en", None, None), (3, "", "en", 0, ""), (3, "", "en", 0, ""), (3, "z", "en", 5, "é\U0001f600"), (None, "s", None, 1, "x"),
    (None, None, None, None, None), (4, "s", "", 2, "no"), (-5, "s", "ß", 2, "no"), (6, "s", "z", (1 << 63) - 1, "w" * 300_000),
]


def many(n):
    """Sizes around whole buckets of levels, one group with most of the rows, many groups of one."""
    return [(i, f"s{i % 3}", "hot" if i % 3 else f"l{i % 40}" if i % 2 else f"only {i}", i, f"text {i}") for i in range(n)]


@pytest.mark.parametrize("rows", [[], ODD, ODD[:1], many(60)])
def test_small_tables(spark, tmp_path, rows):
    docs = frame(spark, rows, SCHEMA).repartition(3)
    clashing = docs.withColumns({c: F.lit("x") for c in ("tree", "rank", "n", "hash", "part", "run", "place", "claimed", "leaf", "leaf_id", "tree_group")})
    assert found(clashing, tmp_path) == by_hand(rows)


@pytest.mark.parametrize("fanout,levels", [(2, 2), (3, 1), (4, 2)])
def test_several_buckets_of_levels(spark, fanout, levels):
    rows = many(400)
    docs = frame(spark, rows, SCHEMA).repartition(7)
    leaf_of = manifest.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    checked = manifest.manifest(docs, "doc_id", "lang", leaf_of, shape=manifest.Shape(fanout, levels))
    assert rows_of(checked, "leaf_id", *RESULT[1:5]) == sorted((r[:5] for r in by_hand(rows, fanout)), key=repr)
    assert checked.filter("not verified or folded_root != root").count() == 0


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert rows_of(driver.queries()["op12_merkle_manifest"](spark, "/root/testdata/sf0.01"), *RESULT) == by_hand(rows)
