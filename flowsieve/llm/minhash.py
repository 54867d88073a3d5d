"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification.

A text is the set of its five-word shingles (`shingles.py`). Two permutations of the 32-bit universe make the
whole signature: the first mixes the shingles, the second, circularly shifted by k, gives coordinate k as
the least value over the set. 32 bands of 4 coordinates nominate pairs: at similarity 0.75 a pair is missed with
a probability of 5e-6. A link needs 100 * |intersection| >= `percent` * |union| on the full sets.

Texts with equal sets are one class and stand for each other, so exact copies cost nothing further. First
every class is checked against one partner, the least of the classes that it meets in its bands; that settles most
groups of near copies in one check a class. Then all pairs that share a band but are not connected yet are checked:
in bands of up to `SMALL` classes pair by pair, in larger ones chunk by chunk, where a task compares two chunks
in arrays and returns at most a row for each class. No nominated pair is left out, no band has to fit one task, and no
pairs of a large band become rows. A band of m classes that stay apart costs m * m comparisons.

Null text is the empty text; texts without words are linked with nothing. Rows that share an id and a text are in
one class. A component with null ids only has a null id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.values import col
from flowsieve.llm.components import components, least_connected
from flowsieve.llm.shingles import mixed, shingle_sets
from flowsieve.llm.tables import filled, free_names, id_text, id_type, join_large_groups, sliced, stored

BANDS, ROWS = 32, 4
SHIFTS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint32)[:, None]
COLUMNS = 512
PERCENT = 75
SMALL, CHUNK = 32, 512


# --- signatures


def first_permutation(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes folded to 32 bits and mixed by a bijection."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k is the least value of the second permutation at (first permutation - k)."""
    placed = first_permutation(shingles)
    least = np.full(len(SHIFTS), 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(placed), COLUMNS):
        x = placed[None, a : a + COLUMNS] - SHIFTS
        t = x >> np.uint32(16)
        x ^= t
        x *= np.uint32(0x85EBCA6B)
        np.right_shift(x, np.uint32(13), out=t)
        x ^= t
        x *= np.uint32(0xC2B2AE35)
        np.right_shift(x, np.uint32(16), out=t)
        x ^= t
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band and its coordinates."""
    rows = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, node (digest of the set) and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, nodes, bands = [], [], []
            for shingles in shingle_sets(filled(batch.column("text"))):
                sizes.append(len(shingles))
                nodes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                bands.append(band_keys(signature(shingles)) if len(shingles) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), lists], names=["doc_id", "text_hash", "n_shingles", "node", "bands"]
            )

    plain = id_text(docs, id_column, text_column).withColumn("text_hash", F.xxhash64("text"))
    return plain.mapInArrow(run, f"doc_id {id_type(plain)}, text_hash bigint, n_shingles bigint, node binary, bands array<bigint>")


# --- verification


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(node: bytes, text: pa.Array) -> np.ndarray:
            if node not in recent:
                recent[node] = next(shingle_sets(text))
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(node)
            return recent[node]

        for batch in sliced(batches):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            text_a, text_b = filled(batch.column("text_a")), filled(batch.column("text_b"))
            good = [similar(of(a[i], text_a.slice(i, 1)), of(b[i], text_b.slice(i, 1)), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


# --- linking


def sizes_allow(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def relabel(table: DataFrame, labels: DataFrame) -> DataFrame:
    """`table` with its column `label` replaced by the component that it is in now."""
    return table.join(labels.select(F.col("node").alias("label"), F.col("label").alias("joined")), "label", "left").withColumn("label", F.coalesce("joined", "label")).drop("joined")


def similar_in_chunks(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all similar pairs, from the exact intersection sizes of every set of `a` with all of `b`."""
    sizes = np.array([len(x) for x in b])
    shingles = np.concatenate(b)
    owner = np.repeat(np.arange(len(b)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    left, right = [], []
    for i, x in enumerate(a):
        low, high = np.searchsorted(shingles, x), np.searchsorted(shingles, x, side="right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        both = np.bincount(owner[at], minlength=len(b))
        near = np.flatnonzero(100 * both >= percent * (len(x) + sizes - both))
        left.append(np.full(len(near), i)), right.append(near)
    return np.concatenate(left), np.concatenate(right)


def link_large_bands(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is similar among the members (band, node, label, k) of bands of k members.

    A band is dealt to chunks by a hash, and each pair of chunks is one task. A task compares its full sets in
    arrays and returns a row per node at most: the least node that it is connected to there.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        first, same = rows["first"].to_numpy(zero_copy_only=False).astype(bool), rows["same"][0].as_py()
        nodes = rows["node"].to_pylist()
        found: list[tuple[bytes, bytes]] = []
        if len(set(rows["label"].to_pylist())) > 1:
            sets = list(shingle_sets(filled(rows["text"])))
            own, other = np.flatnonzero(first), np.arange(len(nodes)) if same else np.flatnonzero(~first)
            if len(own) and len(other):
                left, right = similar_in_chunks([sets[i] for i in own], [sets[i] for i in other], percent)
                least = least_connected(len(nodes), own[left], other[right])
                found = [(nodes[i], nodes[k]) for i, k in enumerate(least.tolist()) if i != k]
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    parts = F.ceil(F.col("k") / CHUNK).cast("int")
    placed = members.select("band", "node", "label", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = met.select("band", "node", "label", (F.col("part") <= F.col("other")).alias("first"), (F.col("part") == F.col("other")).alias("same"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return tasks.join(texts, "node").groupBy("band", "i", "j").applyInArrow(run, "a binary, b binary")


def link(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """node and label of every node in `members` (band, node, n): components of all similar pairs that share a band."""
    current = stored(members.withColumn("label", F.col("node")), "members")
    known = stored(members.select("node").distinct().withColumn("label", F.col("node")), "near-labels")

    def join_labels(links: DataFrame) -> DataFrame:
        """What the links bring together: node (a label) and its new label."""
        of_a, of_b = (known.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
        return components(links.join(of_a, "a").join(of_b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))

    # Every node with one partner: the least of the classes that it meets.
    pivots = stored(current.groupBy("band").agg(F.min(F.struct("node", "n")).alias("p")).select("band", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "pivots")
    met = current.join(pivots, "band").filter((F.col("node") != F.col("pivot")) & sizes_allow(F.col("n"), F.col("pivot_n"), percent))
    lean = met.groupBy("node").agg(F.min("pivot").alias("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    joined = join_labels(stored(verify(lean, texts, percent), "near-links"))
    known, current = stored(relabel(known, joined), "near-labels"), stored(relabel(current, joined), "members")

    # All pairs that share a band and are not connected yet.
    counts = current.groupBy("band").agg(F.count("*").alias("k"), F.min("label").alias("low"), F.max("label").alias("high"))
    spanning = stored(counts.filter("low <> high").select("band", "k"), "spanning-bands")
    open_members = stored(current.join(spanning, "band"), "open-members")
    small = open_members.filter(F.col("k") <= SMALL)
    other = small.select("band", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"))
    pairs = small.select("band", F.col("node").alias("a"), "n", "label").join(other, "band").filter((F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b")) & sizes_allow(F.col("n"), F.col("n_b"), percent))
    checked = stored(verify(pairs.select("a", "b").distinct(), texts, percent), "near-links")
    dense = stored(link_large_bands(open_members.filter(F.col("k") > SMALL), texts, percent), "near-links")
    return stored(relabel(known, join_labels(checked.union(dense))), "near-labels")


# --- the operator


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id (smallest id reachable by links), kept."""
    rows = stored(scan(docs, id_column, text_column), "signatures")
    facts = F.min("doc_id").alias("least_id"), F.count("*").alias("size"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")
    classes = stored(rows.groupBy("node").agg(*facts), "set-classes")
    total = rows.count()
    banded = classes.filter("n > 0").select("node", "n", F.explode("bands").alias("band"))
    shared = stored(banded.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").select("band"), "shared-bands")
    members = stored(banded.join(shared, "band").select("band", "node", "n"), "band-members")
    wanted = members.select("node").distinct().join(classes.select("node", "one.doc_id", "one.text_hash"), "node")
    wanted = wanted.select("node", F.col("doc_id").alias("wanted_id"), "text_hash").hint("shuffle_hash")
    source = id_text(docs, id_column, text_column).withColumn("text_hash", F.xxhash64("text"))
    same = (source["text_hash"] == wanted["text_hash"]) & source["doc_id"].eqNullSafe(wanted["wanted_id"])
    texts = stored(source.join(wanted, same).select("node", "text"), "near-texts")
    labels = link(members, texts, percent)
    named = classes.join(labels, "node", "left").select("node", "size", "least_id", F.coalesce("label", "node").alias("label"))
    named = stored(named, "named-classes")
    least = stored(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "component-ids")
    of_class = stored(named.join(least, "label").select("node", "size", "component_id"), "class-components")
    joined = join_large_groups(rows.drop("bands"), of_class, "node", "size", total)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, all columns as they were: the one with the smallest id.

    Rows that repeat that id and its text stay one row.
    """
    own, first, kept_id, kept_hash = free_names(docs, "own_hash", "first", "kept_id", "kept_hash")
    kept = near_duplicates(docs, id_column, text_column, percent).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).distinct()
    keyed = docs.withColumn(own, F.xxhash64(col(text_column).cast("string")))
    same = (F.col(own) == F.col(kept_hash)) & col(id_column).eqNullSafe(F.col(kept_id))
    place = F.row_number().over(Window.partitionBy(col(id_column), F.col(own)).orderBy(F.lit(1)))
    return keyed.join(kept, same, "left_semi").withColumn(first, place).filter(F.col(first) == 1).select(*[col(c) for c in docs.columns])
