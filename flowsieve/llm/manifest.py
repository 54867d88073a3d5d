"""Merkle manifest of a dataset, with nodes labelled by the interval of leaf ranks that they cover.

A tree has its leaves in order; every `fanout` consecutive nodes of a level become one node of the next (the last may cover
fewer) until one is left. A node's label is its level and the half-open interval of leaf ranks below it, so a node's
ancestor at a level is the one whose interval contains its own, and its siblings cover what its parent's interval has left
and right of its own. Every group of leaves is a tree, and the roots of these trees, in order of their groups, are the leaves of the top tree.

Levels are worked in buckets. Going up, the nodes of one interval of a bucket's span (fan-out to the power of its levels) are one group, and give the
node that covers it. Going down, such a group meets the node that covers it with what its proof holds from there on, and each
of its nodes adds its siblings inside the group. So a group holds one span of nodes, 1,024 by default, and one proof, no leaf is
repeated for each of its ancestors, and the jobs grow with the buckets of levels, not with the levels.

Ranks come from a range partitioning by group, order and digest: partitions and runs of one group inside them are counted,
and only these counts are added up, so a group with most of the rows is spread over all tasks.

Null in any field is written `-`; a null group is a group, the first. Empty and very long texts are hashed whole by the JVM.
Leaves that share group and order (repeated ids, null ids) stand in order of their digests; repeated rows are equal leaves that
each have a place. An empty table gives no rows. Columns that are not named as fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.values import col
from flowsieve.llm.tables import stored

PROOF = "tree bigint, rank bigint, lefts array<string>, rights array<string>"
Proof = tuple[list[str], list[str]]


# --- leaves


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- order


def placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """The leaves by group and order, with their partition, the run of their group in it, and their place in the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, place, last = TaskContext.get().partitionId(), -1, 0, object()
        for batch in batches:
            numbers, places = [], []
            for group in batch.column("tree_group").to_pylist():
                number, place = (number, place + 1) if group == last else (number + 1, 0)
                last = group
                numbers.append(number), places.append(place)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(numbers, pa.int64()), pa.array(places, pa.int64())],
                names=[*batch.schema.names, "part", "run", "place"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields]
    in_order = leaves.repartitionByRange("tree_group", *order).sortWithinPartitions("tree_group", *order)
    return in_order.mapInArrow(run, ", ".join([*fields, "part int, run bigint, place bigint"]))


def ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """The leaves with `tree` (the number of their group, from 0, nulls first), `rank` in it and its size `n`."""
    rows = stored(placed(stored(leaves, "leaves"), order), "leaves-in-order")
    runs = stored(rows.groupBy("part", "run").agg(F.count("*").alias("n"), F.first("tree_group").alias("tree_group")), "runs")
    # One row for each partition: a partition may go on with the group in which the one before ends.
    parts = runs.groupBy("part").agg(F.count("*").alias("runs"), F.min_by("tree_group", "run").alias("first_group"), F.max_by("tree_group", "run").alias("last_group"))
    by_part = Window.orderBy("part")
    same = F.lag("last_group").over(by_part).eqNullSafe(F.col("first_group")) & F.lag("runs").over(by_part).isNotNull()
    parts = parts.withColumn("goes_on", F.coalesce(same, F.lit(False)).cast("bigint"))
    earlier = F.sum(F.col("runs") - F.col("goes_on")).over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", (F.coalesce(earlier, F.lit(0)) - F.col("goes_on")).alias("first_tree"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.drop("tree_group").join(parts, "part").withColumn("tree", F.col("first_tree") + F.col("run"))
    starts = starts.select("part", "run", "tree", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(tree).alias("tree_size"))
    return rows.join(starts, ["part", "run"]).withColumn("rank", F.col("before") + F.col("place")).withColumnRenamed("tree_size", "n").drop("part", "run", "place", "before")


# --- one bucket of levels


@dataclass(frozen=True)
class Shape:
    """How many nodes make one, and how many levels are worked at a time."""

    fanout: int = 2
    levels: int = 10

    @property
    def span(self) -> int:
        return self.fanout**self.levels

    def height(self, n: int) -> int:
        levels = 0
        while n > 1:
            n, levels = -(-n // self.fanout), levels + 1
        return levels

    def climb(self, hashes: list[str], n: int) -> list[list[str]]:
        """The nodes of each level from a bucket's lowest up to the one that covers them; the bucket's level of the tree has n nodes."""
        levels = [hashes]
        for _ in range(min(self.levels, self.height(n))):
            level = levels[-1]
            levels.append([digest("".join(level[i : i + self.fanout])) for i in range(0, len(level), self.fanout)])
        return levels

    def proofs(self, levels: list[list[str]]) -> list[Proof]:
        """For each node of the lowest level, what stands left and right of its interval inside its parent's, level by level."""
        above: list[Proof] = [([], [])]
        for level in reversed(levels[:-1]):
            here = []
            for i in range(len(level)):
                parent = i // self.fanout
                start, end = parent * self.fanout, min((parent + 1) * self.fanout, len(level))
                lefts, rights = above[parent]
                here.append((["".join(level[start:i]), *lefts], ["".join(level[i + 1 : end]), *rights]))
            above = here
        return above


def raise_bucket(nodes: DataFrame, shape: Shape) -> DataFrame:
    """tree, rank, n, hash of the nodes a bucket of levels up, or the root where a tree has fewer levels."""
    span = shape.span

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        n, rank, tree = group["n"][0].as_py(), group["rank"][0].as_py(), group["tree"][0].as_py()
        top = shape.climb(group["hash"].to_pylist(), n)[-1][0]
        return pa.table({"tree": pa.array([tree], pa.int64()), "rank": pa.array([rank // span], pa.int64()), "n": pa.array([-(-n // span)], pa.int64()), "hash": [top]})

    schema = "tree bigint, rank bigint, n bigint, hash string"
    grown = in_buckets(nodes.select("tree", "rank", "n", "hash").filter("n > 1"), span).groupBy("tree", "bucket").applyInArrow(run, schema)
    return grown.unionByName(nodes.filter("n = 1").select("tree", "rank", "n", "hash"))


def in_buckets(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"rank div {span}"))


def lower_bucket(nodes: DataFrame, above: DataFrame, shape: Shape, keep: Callable, schema: str) -> DataFrame:
    """What `keep` makes of each bucket's nodes and their whole proofs, from the proofs of the nodes that cover the buckets."""

    def run(group: pa.Table, cover: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        upper = (cover["lefts"][0].as_py(), cover["rights"][0].as_py())
        own = shape.proofs(shape.climb(group["hash"].to_pylist(), group["n"][0].as_py()))
        return keep(shape, group, [(lefts + upper[0], rights + upper[1]) for lefts, rights in own])

    covering = above.select("tree", F.col("rank").alias("bucket"), "lefts", "rights")
    return in_buckets(nodes, shape.span).groupBy("tree", "bucket").cogroup(covering.groupBy("tree", "bucket")).applyInArrow(run, schema)


def with_proofs(shape: Shape, group: pa.Table, found: list[Proof]) -> pa.Table:
    lists = [pa.array([proof[i] for proof in found], pa.list_(pa.string())) for i in (0, 1)]
    return pa.table({"tree": group["tree"], "rank": group["rank"], "lefts": lists[0], "rights": lists[1]})


def fold(leaf: str, proof: Proof, levels: int | None = None) -> str:
    """The node that a leaf and its proof give so many levels up; the root by default."""
    return reduce(lambda h, sides: digest(sides[0] + h + sides[1]), islice(zip(*proof), levels), leaf)


def verified(shape: Shape, group: pa.Table, found: list[Proof]) -> pa.Table:
    leaves, claims = group["hash"].to_pylist(), group["claimed"].to_pylist()
    return pa.table({
        "leaf_id": group["leaf_id"], "tree_group": group["tree_group"], "leaf": group["hash"],
        "subroot": [fold(leaves[0], found[0], shape.height(group["n"][0].as_py()))] * len(leaves),
        "proof_sha256": [digest("".join(part for sides in zip(*proof) for part in sides)) for proof in found],
        "folded_root": [fold(claim or leaf, proof) for leaf, claim, proof in zip(leaves, claims, found)],
    })


# --- the operator


def climbed(leaves: DataFrame, shape: Shape, name: str) -> list[DataFrame]:
    """The nodes at the bottom of every bucket of levels, from the leaves to the roots: tree, rank, n, hash."""
    buckets = [leaves]
    while (buckets[-1].agg(F.max("n")).first()[0] or 1) > 1:
        buckets.append(stored(raise_bucket(buckets[-1], shape), f"{name}-up-{len(buckets)}"))
    return buckets


def descended(buckets: list[DataFrame], above: DataFrame, shape: Shape, name: str) -> DataFrame:
    """Proofs (tree, rank, lefts, rights) of the lowest of these nodes, from those of the roots."""
    for i, nodes in reversed(list(enumerate(buckets))):
        above = stored(lower_bucket(nodes, above, shape, with_proofs, PROOF), f"{name}-down-{i}")
    return above


def manifest(rows: DataFrame, leaf_id: str, group: str, leaf: Column, claimed: Column | None = None, shape: Shape = Shape()) -> DataFrame:
    """leaf_id, tree_group, leaf, subroot, root, proof_sha256, folded_root and verified, a row for each leaf.

    Leaves of a group ascend by `leaf_id`. `claimed` is the leaf of the data that are checked against the manifest of the rows; null, as by
    default, stands for the leaf itself, which verifies.
    """
    claim = F.lit(None).cast("string") if claimed is None else F.when(claimed != leaf, claimed)
    leaves = rows.select(col(leaf_id).alias("leaf_id"), col(group).alias("tree_group"), leaf.alias("hash"), claim.alias("claimed"))
    leaves = stored(ranked(leaves, ["leaf_id", "hash", "claimed"]), "ranked-leaves")
    lower = climbed(leaves, shape, "nodes")
    subroots = stored(lower[-1].select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.lit(lower[-1].count()).alias("n"), "hash"), "subroots")
    upper = climbed(subroots, shape, "top")
    root = upper[-1].first()
    nothing = F.array().cast("array<string>")
    over = descended(upper[:-1], upper[-1].select("tree", F.lit(0).cast("bigint").alias("rank"), nothing.alias("lefts"), nothing.alias("rights")), shape, "top")
    of_trees = over.select(F.col("rank").alias("tree"), F.lit(0).cast("bigint").alias("rank"), "lefts", "rights")
    cover = descended(lower[1:-1], of_trees, shape, "nodes")
    kind = leaves.schema["leaf_id"].dataType.simpleString(), leaves.schema["tree_group"].dataType.simpleString()
    schema = f"leaf_id {kind[0]}, tree_group {kind[1]}, leaf string, subroot string, proof_sha256 string, folded_root string"
    checked = lower_bucket(leaves, cover, shape, verified, schema).withColumn("root", F.lit(root and root["hash"]).cast("string"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
