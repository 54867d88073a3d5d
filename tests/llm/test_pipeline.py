"""Every stage of the pipeline on its own input, against a brute-force version; edge cases; whole queries on small data."""

from __future__ import annotations

import hashlib
import os
import zlib

import public_tokenizers
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from flowsieve.llm import pii, spans, toxicity
from flowsieve.llm.tables import stored
from flowsieve.queries.registry import table
from llm.samples import LOWER, clashing, edge_docs, frame, near_components, no_docs, plain_private, plain_secrets, rows_of
from llm.test_duplicates import vectors_by_hand
from llm.test_texts import disclosed_by_hand, packed_well

SF = os.environ.get("FLOWSIEVE_SF", "/root/testdata/sf0.001")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def passed(spark):
    """The documents before the first stage and what each stage made of them."""
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_toxic_documents_go(spark, passed):
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(passed[0], table(spark, SF, "labels")).collect()}
    assert ids(passed[1]) == sorted(i for i, p in scored.items() if not p)


def test_exact_copies_go(passed):
    keep = {}
    for doc_id, text in texts(passed[1]):
        key = text.translate(LOWER)
        keep[key] = max(doc_id, keep.get(key, doc_id))
    assert ids(passed[2]) == sorted(keep.values())


def test_near_copies_go(passed):
    assert ids(passed[3]) == sorted(i for i, _, c in near_components(texts(passed[2])) if i == c)


def test_private_data_goes(passed):
    before = texts(passed[3])
    found = {i: s for i, _, s in disclosed_by_hand(before, pii.THRESHOLD, pii.SUPPORT)}
    expected = []
    for doc_id, text in before:
        parts = [s.split(":") for s in found[doc_id].split(",") if s]
        expected.append((doc_id, pii.cleaned(text, [{"kind": k, "start": int(a), "end": int(b)} for k, a, b in parts])))
    assert sorted(texts(passed[4])) == sorted(expected)
    assert all(r["n_chars"] == len(r["text"]) for r in passed[4].collect())


def test_packing_holds_every_token(passed):
    sequences, least = packed_well(passed[5].collect(), texts(passed[4]))
    assert sequences <= 1.01 * least + 1


def test_stages_keep_columns(passed):
    assert all(df.columns == passed[0].columns for df in passed[1:5])


def test_run_gives_the_same_pieces(spark, passed):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(corpus_pipeline.run(spark, SF), *columns) == rows_of(passed[5], *columns)


@pytest.mark.parametrize("make", [edge_docs, no_docs])
def test_stages_on_edge_cases(spark, make):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, make(spark), SF)
        assert (found.count() > 0) == (make is edge_docs), name
        assert name == "best_fit_packing" or found.columns == make(spark).columns


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_private_query(spark):
    found = driver.queries()["op1_private_data"](spark, SF)
    expected = []
    for doc_id, text in texts(table(spark, SF, "documents")):
        base = plain_private(text)
        expected.append((doc_id, *(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")), sha256(spans.joined(base))))
    assert rows_of(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(expected, key=repr)


def test_secrets_query(spark):
    found = driver.queries()["op4_secrets"](spark, SF)
    expected = []
    for doc_id, text in texts(table(spark, SF, "documents")):
        base = plain_secrets(text)
        expected.append((doc_id, *(sum(s[0] == k for s in base) for k in ("assign", "access", "hex")), sha256(spans.joined(base))))
    assert rows_of(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(expected, key=repr)


def test_near_query(spark):
    found = driver.queries()["op3_minhash_near_dedup"](spark, SF)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(near_components(texts(table(spark, SF, "documents"))), key=repr)


def test_bpe_query(spark):
    from flowsieve.llm.bpe import read_ranks, tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
    expected = [(i, len(t := encode(text)), sha256(",".join(map(str, t))), sha256(text)) for i, text in texts(table(spark, SF, "documents"))]
    assert rows_of(driver.queries()["op7_byte_bpe"](spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)


def test_toxicity_query_on_held_out_rows(spark):
    found = {r["doc_id"]: r["score"] for r in driver.queries()["op10_toxicity"](spark, "/root/testdata/sf0.01").filter("held_out").collect()}
    labels = [(found[r["doc_id"]], r["toxic"]) for r in table(spark, "/root/testdata/sf0.01", "labels").collect() if r["doc_id"] in found]
    pairs = [(a > b) + (a == b) / 2 for a, x in labels for b, y in labels if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) > 0.75
    assert sum((s >= 0.3) == y for s, y in labels) > 0.85 * len(labels)


def test_packing_query(spark):
    sequences, least = packed_well(driver.queries()["op5_best_fit_packing"](spark, SF).collect(), texts(table(spark, SF, "documents")))
    assert sequences <= 1.01 * least + 1


def test_shards_query(spark):
    found = driver.queries()["op6_uniform_shards"](spark, SF).collect()
    docs = {i: (text or "").encode() for i, text in texts(table(spark, SF, "documents"))}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sorted((i, len(b) + 8, zlib.crc32(b)) for i, b in docs.items())
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}


def test_vectors_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    found = driver.queries()["op8_embedding_near_dedup"](spark, SF)
    assert rows_of(found, "vec_id", "n_links", "component_id", "kept") == vectors_by_hand(rows, 0.95)


# Names that the stages could use inside, in any case of letters.
TEMPORARY = [
    "__first", "__text_digest", "__text_hash", "__spans", "__key", "__text_key", "__score", "__id", "__hash", "__digest", "_first", "_digest", "_winner", "_won", "_Own_Hash", "_kept_id",
    "_kept_hash", "_own_key", "_found_key", "_found_spans", "_score", "_features", "_margin", "__toxicity_features", "digest", "winner", "score", "node", "key", "a.b", "c d", "label",
]


def test_extra_columns_keep_their_values(spark):
    """Through every stage, each row that stays has what it had in all columns but the text and its length."""
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.lit(" of "), F.col("doc_id").cast("string")) for c in TEMPORARY})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), f"extra-{name}")
        assert out.columns == docs.columns, name
        wrong = F.lit(False)
        for c in TEMPORARY:
            wrong = wrong | ~F.col(f"`{c}`").eqNullSafe(F.concat(F.lit(c), F.lit(" of "), F.col("doc_id").cast("string")))
        assert out.count() > 0 and out.filter(wrong).count() == 0, name
        docs = out
    assert STAGE["best_fit_packing"](spark, docs, SF).count() > 0
