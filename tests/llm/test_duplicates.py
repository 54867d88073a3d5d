from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import embedding_dedup, minhash
from flowsieve.llm.components import components
from flowsieve.llm.exact_dedup import build_pilots, exact_dedup, keep_one, key_words, pilot_of, slots_for
from llm.samples import CLASHING, DOCS, LOWER, edge_docs, frame, near_components, no_docs, rows_of


def exact_by_hand(docs):
    groups: dict = {}
    for doc_id, text in docs:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    out = []
    for doc_id, text in docs:
        key = (text or "").translate(LOWER)
        keep = max((i for i in groups[key] if i is not None), default=None)
        out.append((doc_id, keep, len(groups[key]), doc_id == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 3000])
def test_minimal_perfect_hash_fills_every_slot_once(n):
    words = key_words([hashlib.sha256(str(i).encode()).digest() for i in range(n)])
    pilots = build_pilots(words)
    slots = slots_for(words, pilots[pilot_of(words, len(pilots))], n)
    assert sorted(slots.tolist()) == list(range(n))


@pytest.mark.parametrize("history", [None, "true", "false", "doc_id < 5"])
def test_exact_groups_do_not_depend_on_the_history(spark, history):
    found = exact_dedup(edge_docs(spark), F.expr(history) if history else None).withColumn("sha", F.lower(F.hex("digest")))
    assert rows_of(found, "doc_id", "keep_id", "group_size", "kept", "sha") == exact_by_hand(DOCS)


def test_exact_history_is_looked_up(spark):
    docs = [(i, f"text {i % 700}") for i in range(2000)]
    found = exact_dedup(frame(spark, docs), F.col("doc_id") < 900)
    assert rows_of(found.withColumn("sha", F.lower(F.hex("digest"))), "doc_id", "keep_id", "group_size", "kept", "sha") == exact_by_hand(docs)
    assert found.filter("in_history").count() == 2000


def test_keep_one_keeps_one_row_of_each_text(spark):
    kept = keep_one(edge_docs(spark))
    assert kept.columns == ["doc_id", "text", *CLASHING]
    assert kept.select(F.translate(F.coalesce("text", F.lit("")), "AGHINW", "aghinw")).distinct().count() == kept.count() == len({(t or "").translate(LOWER) for _, t in DOCS})


def test_near_duplicates_on_edge_cases(spark):
    found = minhash.near_duplicates(edge_docs(spark))
    expected = [(i, n, c, i == c) for i, n, c in near_components(DOCS)]
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(expected, key=repr)
    kept = minhash.keep_representatives(edge_docs(spark))
    assert kept.columns == ["doc_id", "text", *CLASHING]
    assert kept.filter("doc_id in (9, 10)").count() == 1 and kept.filter("doc_id in (1, 2)").count() == 1


def test_near_duplicates_against_brute_force(spark):
    """Drifting chains, a dense group, and texts that share half of their words."""
    rng = random.Random(5)
    docs, text = [], [f"w{rng.random()}" for _ in range(60)]
    for i in range(60):
        text = text[:]
        text[rng.randrange(60)] = f"v{rng.random()}"
        docs.append((i, " ".join(text)))
    base = [f"b{i}" for i in range(80)]
    for i in range(60, 120):
        copy = base[:]
        for k in rng.sample(range(80), rng.randrange(4)):
            copy[k] = f"c{rng.random()}"
        docs.append((i, " ".join(copy)))
    docs += [(i, " ".join([*base[:50], *(f"d{i}.{k}" for k in range(rng.randrange(5, 40)))])) for i in range(120, 180)]
    rng.shuffle(docs)
    found = minhash.near_duplicates(frame(spark, docs).repartition(4))
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(near_components(docs), key=repr)


def test_signature_is_a_fair_estimate():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(100):
        common, a, b = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (300, 60, 60))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        errors.append((minhash.signature(x) == minhash.signature(y)).mean() - 300 / 420)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    rng = random.Random(2)
    rng.shuffle(links)
    found = {r["node"]: r["label"] for r in components(frame(spark, links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, **{i: 300 for i in (300, 301, 302)}}
    assert components(frame(spark, [], "a bigint, b bigint")).count() == 0


def vectors_by_hand(rows, cosine):
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    units = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float) / max(map(abs, v))) / max(map(abs, v)) if ok else None for (_, v), ok in zip(rows, usable)]
    near = [[j for j in range(len(rows)) if usable[i] and usable[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    ids = [min((rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None), default=None) if usable[i] else rows[i][0] for i in range(len(rows))]
    return sorted(((rows[i][0], max(0, len(near[i]) - 1), ids[i], rows[i][0] == ids[i]) for i in range(len(rows))), key=repr)


def test_near_vectors_on_edge_cases(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((20, 16))
    rows = [(i, (centre[i % 20] + 0.15 * rng.standard_normal(16)).tolist()) for i in range(200)]
    a = rows[0][1]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [float("inf"), *a[1:]]), (204, [None, *a[1:]]), (205, []), (206, a), (206, a), (None, a), (207, [x * 1e200 for x in a]), (208, a[:8]), (209, a[:8]), (210, [-x for x in a])]
    df = frame(spark, rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(None).cast("string") for c in ("node", "dim", "vector", "bin", "size", "label")})
    found = embedding_dedup.near_vectors(df.repartition(3))
    assert rows_of(found, "vec_id", "n_links", "component_id", "kept") == vectors_by_hand(rows, 0.95)


def test_near_vectors_across_parts_and_groups(spark, monkeypatch):
    """Small cells and parts, so that links cross parts and pairs meet in several groups; each is counted once."""
    monkeypatch.setattr(embedding_dedup, "PART", 16)
    monkeypatch.setattr(embedding_dedup, "MATES", 24)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((60, 24))
    rows = [(i, (centre[i % 60] + 0.08 * rng.standard_normal(24)).astype("f4").tolist()) for i in range(300)]
    assert embedding_dedup.cells_for(300, 0.4, 0.95).groups > 3
    found = embedding_dedup.near_vectors(frame(spark, rows, "vec_id bigint, embedding array<float>"))
    assert rows_of(found, "vec_id", "n_links", "component_id", "kept") == vectors_by_hand(rows, 0.95)


def planted(rng, clusters, size, dim, noise):
    centre = rng.standard_normal((clusters, dim))
    return (centre[np.arange(clusters * size) % clusters] + noise * rng.standard_normal((clusters * size, dim))).astype("f4")


def test_recall_on_planted_vectors(spark):
    """12,000 vectors, most of them alone, thousands of pairs just above the least cosine, and one dense cluster of 1,500."""
    rng = np.random.default_rng(11)
    x = np.concatenate([planted(rng, 2500, 3, 64, 0.22), planted(rng, 1, 1500, 64, 0.1), rng.standard_normal((3000, 64)).astype("f4")])
    units = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = [(units[i : i + 1000] @ units.T >= 0.95).sum(axis=1) - 1 for i in range(0, len(x), 1000)]
    near = np.concatenate(near)
    close = units[:7500].reshape(3, 2500, 64)
    cosines = np.einsum("ijk,ijk->ij", close[[0, 0, 1]], close[[1, 2, 2]])
    assert ((cosines >= 0.95) & (cosines < 0.96)).sum() > 400 and near[7500:9000].min() > 1000
    found = embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"))
    links = np.zeros(len(x), dtype=int)
    for r in found.select("vec_id", "n_links").collect():
        links[r["vec_id"]] = r["n_links"]
    assert (links <= near).all() and links[:7500].sum() >= 0.995 * near[:7500].sum() and (links[7500:9000] == near[7500:9000]).mean() > 0.98


def test_vectors_sent_grow_like_their_number(spark):
    """Four times the vectors, at most seven times the rows; if all runs met all others, sixteen times as many."""
    sent = []
    for n in (12_000, 48_000):
        x = np.random.default_rng(n).standard_normal((n, 64))
        classes = spark.createDataFrame([(i.to_bytes(4, "big"), 1, 64, v.tobytes()) for i, v in enumerate(x)], "node binary, size bigint, dim int, vector binary")
        sent.append(embedding_dedup.meetings(classes, 0.95).count())
    assert sent[1] < 7 * sent[0]


def test_chances_of_near_vectors():
    """The stated losses: few collisions, and no common cell."""
    p = math.erf(embedding_dedup.WINDOW_DEVIATIONS / math.sqrt(2))
    assert sum(math.comb(24, k) * p**k * (1 - p) ** (24 - k) for k in range(embedding_dedup.least_collisions())) <= embedding_dedup.MISSED
    rng = np.random.default_rng(2)
    for width in (0.5, 2.0, 6.0):
        start, step = rng.random(400_000) * width, rng.standard_normal(400_000)
        assert abs(np.mean(np.floor(start / width) == np.floor((start + step) / width)) - embedding_dedup.same_cell(width)) < 0.004
    for n in (100, 5_000, 10**5, 10**9):
        cells = embedding_dedup.cells_for(n, 0.467, 0.95)
        assert (1 - embedding_dedup.same_cell(6.0) ** cells.lines) ** cells.groups <= embedding_dedup.UNMET
        assert n * 0.467**cells.lines < 3 * embedding_dedup.MATES and cells.groups < 150


def test_empty_tables(spark):
    for found in (exact_dedup(no_docs(spark)), keep_one(no_docs(spark)), minhash.near_duplicates(no_docs(spark)), minhash.keep_representatives(no_docs(spark))):
        assert found.count() == 0
    assert embedding_dedup.near_vectors(frame(spark, [], "vec_id bigint, embedding array<float>")).count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_defeat_polynomials_modulo_powers_of_two(spark):
    """Words that share all such hashes, alone, inside long texts and as one word longer than a piece, are not linked."""
    words = [thue_morse(2048, "ab"), thue_morse(2048, "ba"), thue_morse(4096, "xy"), thue_morse(4096, "yx")]
    docs = [*enumerate(words), (10, f"{words[0]} tail"), (11, f"{words[1]} tail"), (12, words[0].upper())]
    docs += [(20, words[2] * 200), (21, words[3] * 200)]
    found = minhash.near_duplicates(frame(spark, docs))
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(near_components(docs), key=repr)
