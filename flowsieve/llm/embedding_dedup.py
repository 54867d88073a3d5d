"""Near-duplicate vectors by collision counting on one-dimensional projections.

Every vector, scaled to length one, is projected on many random directions. On one direction the values of a pair at the least
cosine differ by a normal number with the pair's distance as deviation, so every chance below is known beforehand.

Which vectors meet: the directions are taken in groups. On each direction of a group the sorted values are cut into cells
`CELL_DEVIATIONS` wide from a random start, and the vectors that share the cells of all directions of a group meet, so that a vector is sent once
for each group and never to all others. A group has as many directions as leave about `MATES` unrelated vectors in a cell, from the shares of the
cells counted on all vectors; there are as many groups as leave at most `UNMET` of the pairs at the least cosine without a common cell (closer
pairs meet more often). Vectors sent therefore grow like n to the power 1.19 for vectors without any structure, and not like its square.

What is counted: of each two vectors that meet, the collisions on `PROJECTIONS` further directions, in windows centred on the query. The
least count that a pair must reach is calibrated so that at most `MISSED` of the pairs at the least cosine stay below it. Pairs that reach it are
verified by their cosine in double precision. A pair that meets in several groups is taken in the first of them.

A cell of more than `PART` vectors is split by a hash, and its parts meet two at a time. Tasks return a row per vector: its links there and
the least vector it is connected to, so that dense groups do not become pairs. Equal vectors are one class.

Vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing, nor are
vectors of different lengths. Repeated rows and ids each get their row. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.tables import BROADCAST_ROWS
from flowsieve.functions.values import col
from flowsieve.llm.components import components, least_connected
from flowsieve.llm.tables import id_type, join_large_groups, stored

PROJECTIONS, PART, TILE = 24, 2048, 512
MISSED, UNMET = 1e-5, 1e-3
WINDOW_DEVIATIONS, CELL_DEVIATIONS, MATES = 2.0, 6.0, 512
UNITS, PILOT = 1000, 16


@lru_cache(maxsize=64)
def directions(dim: int, n: int = PROJECTIONS, use: int = 7) -> np.ndarray:
    return np.random.default_rng([use, dim]).standard_normal((dim, n))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow on the way."""
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def least_collisions(missed: float = MISSED) -> int:
    """The largest count that all but `missed` of the pairs at the least cosine reach."""
    p, below = math.erf(WINDOW_DEVIATIONS / math.sqrt(2)), 0.0
    for k in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if below > missed:
            return k
    return PROJECTIONS


def same_cell(width: float) -> float:
    """The chance that two values whose difference is normal with deviation 1 share a cell of this width with a random start."""
    return math.erf(width / math.sqrt(2)) - math.sqrt(2 / math.pi) / width * (1 - math.exp(-width * width / 2))


@dataclass(frozen=True)
class Cells:
    """Groups of directions, how many directions each has, and the width of cells."""

    groups: int
    lines: int
    width: float

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One number for each row and group: the cells of the group's directions, mixed to 32 bits; other cells that get the same number meet, too."""
        if not self.lines:
            return np.zeros((len(x), self.groups), dtype=np.int32)
        n, dim = self.groups * self.lines, x.shape[1]
        rng = np.random.default_rng([13, dim, n])
        starts, odd = rng.random(n), rng.integers(0, 1 << 62, n, dtype=np.int64) * 2 + 1
        cells = np.floor(units(x) @ directions(dim, n, 11) / self.width + starts).astype(np.int64)
        mixed = (cells * odd).reshape(len(x), self.groups, self.lines).sum(axis=2)
        return ((mixed ^ mixed >> 31) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def cells_for(n: int, together: float, cosine: float) -> Cells:
    """For n vectors, of which two at random share a cell of a direction with the chance `together`."""
    near = same_cell(CELL_DEVIATIONS)
    lines = max(0, math.floor(math.log(max(n, 1) / MATES) / -math.log(min(together, 0.99)))) if n > 2 * MATES else 0
    groups = math.ceil(math.log(UNMET) / math.log(1 - near**lines)) if lines else 1
    return Cells(groups, lines, CELL_DEVIATIONS * math.sqrt(2 - 2 * cosine))


def scan(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """One row per vector: vec_id, node (digest; null where it cannot be linked), dim, vector (bytes of its numbers, of four each if these hold them exactly, else of eight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, dims, data = [], [], []
            for value in batch.column("vector"):
                x = None
                if value.is_valid and len(value.values) and not value.values.null_count:
                    x = value.values.to_numpy(zero_copy_only=False).astype("<f8")
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                if x is None:
                    nodes.append(None), dims.append(None), data.append(None)
                    continue
                nodes.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
                with np.errstate(over="ignore"):
                    single = x.astype("<f4")
                dims.append(len(x)), data.append((single if (single == x).all() else x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "node", "dim", "vector"])

    plain = vectors.select(col(id_column).alias("vec_id"), col(vector_column).cast("array<double>").alias("vector"))
    return plain.mapInArrow(run, f"vec_id {id_type(plain, 'vec_id')}, node binary, dim int, vector binary")


def rows_of_numbers(data: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one dimension as rows of doubles."""
    values = data.to_pylist()
    if all(len(v) == 4 * dim for v in values):
        return np.frombuffer(b"".join(values), dtype="<f4").reshape(-1, dim).astype("<f8")
    return np.array([np.frombuffer(v, dtype="<f4" if len(v) == 4 * dim else "<f8") for v in values], dtype="<f8").reshape(-1, dim)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each dimension's rows."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield at, rows_of_numbers(batch.column("vector").take(pa.array(at)), int(dim))


def shares_of_cells(classes: DataFrame, width: float) -> float:
    """The chance that two of the vectors share a cell of a direction: the mean over `PILOT` directions, from the counts of their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, x in matrices(batch):
                cells = np.floor(units(x) @ directions(x.shape[1], PILOT, 17) / width).astype(np.int64)
                for line in range(PILOT):
                    found, n = np.unique(cells[:, line], return_counts=True)
                    counts.update({(line, x.shape[1], c): k for c, k in zip(found.tolist(), n.tolist())})
        lists = list(zip(*[(*key, n) for key, n in counts.items()])) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in lists], names=["line", "dim", "cell", "n"])

    counted = classes.select("dim", "vector").mapInArrow(run, "line bigint, dim bigint, cell bigint, n bigint").groupBy("line", "dim", "cell").agg(F.sum("n").alias("n"))
    of_lines = counted.groupBy("line").agg((F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))).alias("share"))
    return of_lines.agg(F.coalesce(F.avg("share"), F.lit(1.0)).alias("share")).first()["share"]


def with_keys(classes: DataFrame, cells: Cells) -> DataFrame:
    """The classes with the keys of their cells, one for each group; stored, so that all tasks see the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, cells.groups), dtype=np.int32)
            for at, x in matrices(batch):
                keys[at] = cells.keys(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, cells.groups, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "keys"])

    return stored(classes.mapInArrow(run, "node binary, size bigint, dim int, vector binary, keys array<int>"), "vector-keys")


def verified_links(a: np.ndarray, b: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the pairs with enough collisions whose cosine is large enough; for one run each pair once."""
    scaled = [x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b)]
    norms = [np.sqrt((x * x).sum(axis=1)) for x in scaled]
    window = WINDOW_DEVIATIONS * math.sqrt(2 - 2 * cosine)
    lines = directions(a.shape[1])
    places = [np.rint((x / n[:, None]) @ lines * (UNITS / window)).astype(np.int16).T.copy() for x, n in zip(scaled, norms)]
    least = least_collisions()
    left, right = [], []
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            p, q = places[0][:, i : i + TILE], places[1][:, j : j + TILE]
            count = np.zeros((p.shape[1], q.shape[1]), dtype=np.int8)
            for line in range(PROJECTIONS):
                count += np.abs(p[line][:, None] - q[line][None, :]) <= UNITS
            x, y = np.nonzero(count >= least)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 1 << 15):
                u, v = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
                good = (scaled[0][u] * scaled[1][v]).sum(axis=1) >= cosine * norms[0][u] * norms[1][v]
                left.append(u[good]), right.append(v[good])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links_of_part(rows: list[pa.RecordBatch], group: int, dim: int, same: bool, cosine: float) -> pa.RecordBatch:
    """node, links, least of the vectors of one part, or of two parts that meet, by the pairs that meet here first."""
    table = pa.Table.from_batches(rows).combine_chunks()
    second = table["second"].to_numpy().astype(bool)
    table = table.take(pa.array(np.argsort(second, kind="stable")))
    n_first = len(second) if same else int((~second).sum())
    x = rows_of_numbers(table["vector"], dim)
    keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(second), -1)[:, :group]
    left, right = verified_links(x[:n_first], x[:n_first] if same else x[n_first:], same, cosine)
    right = right if same else right + n_first
    pieces = range(0, len(left), 1 << 18)
    new = np.concatenate([np.zeros(0, dtype=bool), *(~(keys[left[i : i + (1 << 18)]] == keys[right[i : i + (1 << 18)]]).any(axis=1) for i in pieces)])
    left, right = left[new], right[new]
    sizes, links = table["size"].to_numpy(), np.zeros(len(second), dtype=np.int64)
    np.add.at(links, left, sizes[right])
    np.add.at(links, right, sizes[left])
    label = least_connected(len(second), left, right)
    touched = np.flatnonzero(links)
    nodes = table["node"].combine_chunks()
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(touched)), pa.array(links[touched]), nodes.take(pa.array(label[touched]))], names=["node", "links", "least"])


def meet(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by place of meeting; one place after the other is worked on."""
    place, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in PLACE]
        starts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            if end == start:
                continue
            here = tuple(int(c[start]) for c in columns)
            if here != place:
                if sum(part.num_rows for part in held) > 1:
                    yield links_of_part(held, place[0], place[1], place[3] == place[4], cosine)
                place, held = here, []
            held.append(batch.slice(start, end - start))
    if sum(part.num_rows for part in held) > 1:
        yield links_of_part(held, place[0], place[1], place[3] == place[4], cosine)


PLACE = ["group", "dim", "key", "a", "b"]


def meetings(classes: DataFrame, cosine: float) -> DataFrame:
    """The vectors at every place where they meet others: a row for each group, and in large cells for each part that theirs meets."""
    width = CELL_DEVIATIONS * math.sqrt(2 - 2 * cosine)
    keyed = with_keys(classes, cells_for(classes.count(), shares_of_cells(classes, width), cosine))
    met = keyed.select("node", "size", "dim", "vector", "keys", F.posexplode("keys").alias("group", "key"))
    large = stored(met.groupBy("group", "dim", "key").agg(F.count("*").alias("n")).filter(F.col("n") > PART), "large-cells")
    parts = large.select("group", "dim", "key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    parts = F.broadcast(parts) if large.count() <= BROADCAST_ROWS else parts
    placed = met.join(parts, ["group", "dim", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    others = placed.select("node", "size", "dim", "vector", "keys", "group", "key", part, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    ends = F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")
    return others.select("node", "size", "vector", "keys", "group", "dim", "key", *ends, (F.col("part") > F.col("other")).alias("second"))


def count_links(classes: DataFrame, cosine: float) -> DataFrame:
    """node, links (other vectors linked to it in a place of meeting), least (a node that it is connected to) from node, size, dim, vector."""
    in_order = meetings(classes, cosine).repartition(*PLACE).sortWithinPartitions(*PLACE)
    return in_order.mapInArrow(lambda batches: meet(batches, cosine), "node binary, links bigint, least binary")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept."""
    rows = stored(scan(vectors, id_column, vector_column), "vectors")
    facts = F.min("vec_id").alias("least_id"), F.count("*").alias("size"), *(F.first(c).alias(c) for c in ("dim", "vector"))
    classes = stored(rows.filter("node is not null").groupBy("node").agg(*facts), "vector-classes")
    counted = stored(count_links(classes.drop("least_id"), cosine), "vector-links")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(counted.select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = classes.select("node", "size", "least_id").join(links, "node", "left").join(labels, "node", "left")
    named = stored(named.withColumn("label", F.coalesce("label", "node")), "vector-labels")
    least = stored(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "vector-components")
    of_class = stored(named.join(least, "label").select("node", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"), "vector-facts")
    linked = join_large_groups(rows.filter("node is not null").select("vec_id", "node"), of_class, "node", "size", rows.count())
    alone = rows.filter("node is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
