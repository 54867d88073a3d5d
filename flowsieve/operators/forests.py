"""Random forests grown from binned rows, for tables on which MLlib's own fit takes too long.

The forest is MLlib's: candidates for splits from the quantiles of a sample, a Poisson(1) number of draws of each row for each tree, a random
choice of features for each node, the split with the largest gain, levels until the depth is reached or a node is pure. The rows are read once
as vectors; from then on a row is a byte for each feature. A level is one Spark job: every task counts, for all trees, its rows by node, chosen
feature, bin and label; the counts meet by tree and nodes, where the best splits are found; only these reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, factorial, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.values import col
from flowsieve.operators.blocks import LABEL_TYPE, Scaling, matrix, packed
from flowsieve.sources.fitted import write_metadata
from flowsieve.sources.workspace import dropped, scratch_path

# Rows that candidates for splits come from, at least; MLlib takes 10,000.
SAMPLE_ROWS = 50_000
# Nodes of a level have numbers in arrays of two to the depth.
MOST_DEPTH = 14
BLOCK_ROWS = 1 << 15
# Rows that a task holds at once, cells that it counts for a tree at once, and cells in a row that it sends.
TASK_ROWS, TASK_CELLS, ROW_CELLS = 1 << 21, 1 << 22, 1 << 17
# Draws of a row: the largest number whose table entry is at most a random number of 16 bits.
POISSON = np.repeat(np.arange(9), np.diff([0, *(round(65536 * sum(np.exp(-1) / factorial(i) for i in range(k + 1))) for k in range(8)), 65536])).astype(np.uint8)
IMPURITY_OF_PURE = 2.0**-52
COUNTED = "tree int, low int, nodes int, kind string, counts binary"
FOUND = "tree int, slot int, feature int, bin int, gain double, whole array<double>, left array<double>"


def supported(forest: RandomForestClassifier) -> bool:
    """Whether the settings are among those that are built here."""
    plain = forest.getImpurity() == "gini" and forest.getSubsamplingRate() == 1.0 and forest.getBootstrap() and not forest.isDefined(forest.weightCol)
    strategy = forest.getFeatureSubsetStrategy() in ("auto", "all", "sqrt", "log2", "onethird") and not forest.isSet(forest.thresholds)
    return plain and strategy and forest.getMinWeightFractionPerNode() == 0.0 and forest.getMaxDepth() <= MOST_DEPTH and forest.getMaxBins() <= 256


def chosen_per_node(forest: RandomForestClassifier, features: int) -> int:
    strategy = forest.getFeatureSubsetStrategy()
    if strategy == "auto":
        strategy = "sqrt" if forest.getNumTrees() > 1 else "all"
    most = {"all": features, "sqrt": ceil(sqrt(features)), "log2": max(1, ceil(log2(features))), "onethird": ceil(features / 3)}[strategy]
    return min(features, most)


def split_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between the values of a sample: between all of them if they are few, else where a bin's share of the rows is nearest."""
    found, counts = np.unique(values, return_counts=True)
    between = found[:-1] + (found[1:] - found[:-1]) / 2
    if len(between) < bins:
        return between
    stride, points, upto = len(values) / bins, [], int(counts[0])
    target = stride
    for i, count in enumerate(counts[1:].tolist()):
        before, upto = upto, upto + count
        if abs(before - target) < abs(upto - target):
            points.append(between[i])
            target += stride
    return np.array(points)


def candidates(rows: DataFrame, total: int, features: Sequence[str], scaling: Scaling, bins: int, seed: int) -> list[np.ndarray]:
    """Thresholds of every feature, from a sample of the rows as MLlib takes one."""
    wanted = max(bins * bins, SAMPLE_ROWS)
    sample = rows if total <= wanted else rows.sample(wanted / total, seed)
    table = sample.select(*[col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]).toArrow()
    return [split_points(values, bins) for values in scaling.apply(matrix(table, table.column_names))]


@dataclass(frozen=True)
class Frontier:
    """What a task needs to know of the trees: how to walk down to the level, and the nodes that are to be split there.

    `feature` and `limit` are by tree and node in level order; a node that is a leaf sends all rows to the left. `slot` is by tree and place in the
    level, -1 for what is no node to split; `chosen` has the features of these nodes by tree and slot.
    """

    depth: int
    feature: np.ndarray
    limit: np.ndarray
    slot: np.ndarray
    chosen: list[np.ndarray]


def draws(seed: int, tree: int, block: int, rows: int) -> np.ndarray:
    """How often each row of a block is drawn for a tree: the same in every pass."""
    numbers = np.random.PCG64([seed, tree, block]).random_raw(rows // 4 + 1)
    return POISSON.take(numbers.view(np.uint16)[:rows])


def counting(frontier: Frontier, width: int, bins: int, labels: int, seed: int):
    """Counts of a task's rows by tree, node, chosen feature, bin and label."""
    cells = bins * labels
    code_type = np.uint8 if cells <= 1 << 8 else np.uint16 if cells <= 1 << 16 else np.uint32
    limit = ((frontier.limit.astype(np.int64) + 1) * labels - 1).astype(code_type)

    def places(codes: np.ndarray, start: np.ndarray, tree: int) -> np.ndarray:
        """The slots that the rows, of which each begins at `start`, come to; -1 for those in leaves."""
        at, feature = np.zeros(len(start), dtype=np.intp), frontier.feature[tree].astype(np.intp)
        for level in range(frontier.depth):
            node = at + ((1 << level) - 1)
            code = codes.take(start + feature.take(node), mode="clip")
            at += at
            at += code > limit[tree].take(node, mode="clip")
        return frontier.slot[tree].take(at, mode="clip")

    def tree_counts(held: list[tuple[int, int, np.ndarray]], tree: int, low: int, high: int) -> np.ndarray:
        chosen = frontier.chosen[tree][low:high]
        of_place = np.ascontiguousarray(chosen.T).astype(np.intp)
        counts = np.zeros((chosen.shape[1], (high - low) * cells))
        for number, rows, codes in held:
            times = draws(seed, tree, number, rows)
            drawn = np.flatnonzero(times != 0)
            start = drawn * width
            slot = places(codes, start, tree)
            inside = np.flatnonzero((slot >= low) & (slot < high))
            if len(inside) < len(slot):
                drawn, start, slot = drawn.take(inside), start.take(inside), slot.take(inside)
            if not len(slot):
                continue
            slot, weight = slot - low, times.take(drawn).astype(float)
            base = slot * cells
            for j in range(len(counts)):
                code = codes.take(start + of_place[j].take(slot, mode="clip"), mode="clip")
                counts[j] += np.bincount(base + code, weight, counts.shape[1])
        return counts.reshape(chosen.shape[1], high - low, cells)

    def count(held: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for tree, chosen in enumerate(frontier.chosen):
            per_node = max(1, chosen.shape[1] * cells) if len(chosen) else 1
            for low in range(0, len(chosen), step := max(1, TASK_CELLS // per_node)):
                high = min(len(chosen), low + step)
                counts = tree_counts(held, tree, low, high)
                for first in range(low, high, part := max(1, ROW_CELLS // per_node)):
                    piece = counts[:, first - low : min(high, first + part) - low]
                    kind = np.min_scalar_type(int(piece.max()))
                    row = {"tree": [tree], "low": [first], "nodes": [piece.shape[1]], "kind": [kind.str], "counts": [piece.astype(kind).tobytes()]}
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()))], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for number, rows, label, numbers in zip(*(batch.column(c) for c in ("block", "rows", "labels", "numbers"))):
                rows = rows.as_py()
                binned = np.frombuffer(numbers.as_buffer(), np.uint8).reshape(rows, width)
                codes = binned.astype(code_type) * code_type(labels) + np.frombuffer(label.as_buffer(), LABEL_TYPE).astype(code_type)[:, None]
                held.append((number.as_py(), rows, codes.ravel()))
                waiting += rows
                if waiting >= TASK_ROWS:
                    yield from count(held)
                    held, waiting = [], 0
        if held:
            yield from count(held)

    return run


def gini(counts: np.ndarray) -> np.ndarray:
    """By the last axis; zero without rows."""
    total = counts.sum(axis=-1)
    return np.where(total > 0, 1.0 - (counts**2).sum(axis=-1) / np.maximum(total, 1.0) ** 2, 0.0)


def best_splits(chosen: list[np.ndarray], bins: int, labels: int, least_rows: int, least_gain: float):
    """The counts of some nodes of a tree added up over the tasks, and the best split of each node; feature -1 if none is valid."""

    def run(group: pa.Table) -> pa.Table:
        tree, low, nodes = (group.column(c)[0].as_py() for c in ("tree", "low", "nodes"))
        features = chosen[tree][low : low + nodes]
        total = np.zeros(features.shape[1] * nodes * bins * labels)
        for kind, counts in zip(group.column("kind"), group.column("counts")):
            total += np.frombuffer(counts.as_buffer(), kind.as_py())
        total = total.reshape(features.shape[1], nodes, bins, labels).transpose(1, 0, 2, 3)
        left = total.cumsum(axis=2)[:, :, :-1]
        whole = total[:, 0].sum(axis=1)
        right = whole[:, None, None] - left
        rows, rows_left, rows_right = whole.sum(axis=1)[:, None, None], left.sum(axis=3), right.sum(axis=3)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gini(whole)[:, None, None] - (rows_left * gini(left) + rows_right * gini(right)) / rows
        usable = (rows_left >= max(1, least_rows)) & (rows_right >= max(1, least_rows)) & (gain >= least_gain) & (gain > 0)
        gain = np.where(usable, gain, -1.0).reshape(nodes, -1)
        best = gain.argmax(axis=1)
        place, at = np.divmod(best, bins - 1)
        every = np.arange(nodes)
        found = gain[every, best] > 0
        columns = {
            "tree": pa.array(np.full(nodes, tree), pa.int32()), "slot": pa.array(low + every, pa.int32()), "feature": pa.array(np.where(found, features[every, place], -1), pa.int32()),
            "bin": pa.array(at, pa.int32()), "gain": pa.array(gain[every, best]), "whole": pa.array(list(whole), pa.list_(pa.float64())),
            "left": pa.array(list(left[every, place, at]), pa.list_(pa.float64())),
        }
        return pa.table(columns)

    return run


@dataclass
class Trees:
    """Trees in level order: the split of each node (feature -1: a leaf), its gain, and the rows of each label in it."""

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    counts: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int, labels: int) -> Trees:
        nodes = (2 << depth) - 1
        return cls(np.full((trees, nodes), -1), np.zeros((trees, nodes), np.intp), np.full((trees, nodes), -1.0), np.zeros((trees, nodes, labels)))

    def frontier(self, level: int, waiting: list[np.ndarray], chosen: list[np.ndarray], bins: int) -> Frontier:
        above = (1 << level) - 1
        split = self.feature[:, :above] >= 0
        slot = np.full((len(waiting), 1 << level), -1, dtype=np.intp)
        for tree, places in enumerate(waiting):
            slot[tree, places] = np.arange(len(places))
        feature = np.where(split, self.feature[:, :above], 0).astype(np.int32)
        return Frontier(level, feature, np.where(split, self.bin[:, :above], bins - 1).astype(np.int16), slot, chosen)

    def grow(self, level: int, waiting: list[np.ndarray], found: pa.Table) -> list[np.ndarray]:
        """Enter the splits of a level; the places in the next one that are not pure."""
        if not found.num_rows:
            return [np.zeros(0, np.intp) for _ in waiting]
        tree, slot, feature, at, gain = (found.column(c).to_numpy() for c in ("tree", "slot", "feature", "bin", "gain"))
        whole, left = (np.array(found.column(c).to_pylist(), dtype=float) for c in ("whole", "left"))
        place = np.array([waiting[t][s] for t, s in zip(tree, slot)])
        node = place + (1 << level) - 1
        self.feature[tree, node], self.bin[tree, node], self.gain[tree, node], self.counts[tree, node] = feature, at, gain, whole
        split = feature >= 0
        below, following = 2 * node[split] + 1, []
        self.counts[tree[split], below], self.counts[tree[split], below + 1] = left[split], (whole - left)[split]
        mixed = gini(self.counts) > IMPURITY_OF_PURE
        first = (2 << level) - 1
        for number in range(len(waiting)):
            children = np.sort(np.concatenate([n := below[tree[split] == number], n + 1]))
            following.append(children[mixed[number, children]] - first)
        return following

    def rows(self, tree: int, thresholds: list[np.ndarray]) -> list[dict]:
        """The nodes of a tree as MLlib stores them, numbered from the root to the left; leaves with one parent and one prediction are put together."""
        impurity, prediction, stored = gini(self.counts[tree]), self.counts[tree].argmax(axis=1), []
        leaf = self.feature[tree] < 0
        for node in range((len(leaf) - 1) // 2 - 1, -1, -1):
            a, b = 2 * node + 1, 2 * node + 2
            leaf[node] = leaf[node] or (leaf[a] and leaf[b] and prediction[a] == prediction[b])

        def add(node: int) -> int:
            number, counts = len(stored), self.counts[tree, node]
            facts = {"id": number, "prediction": float(prediction[node]), "impurity": float(impurity[node]), "impurityStats": counts.tolist(), "rawCount": int(counts.sum())}
            stored.append(facts)
            if leaf[node]:
                facts |= {"gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
            else:
                feature = int(self.feature[tree, node])
                threshold = float(thresholds[feature][self.bin[tree, node]])
                facts |= {"gain": float(self.gain[tree, node]), "split": {"featureIndex": feature, "leftCategoriesOrThreshold": [threshold], "numCategories": -1}}
                facts["leftChild"], facts["rightChild"] = add(2 * node + 1), add(2 * node + 2)
            return number

        add(0)
        return stored


NODES = pa.schema([
    ("treeID", pa.int32()),
    ("nodeData", pa.struct([
        ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()),
        ("leftChild", pa.int32()), ("rightChild", pa.int32()),
        ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
    ])),
])


def as_model(spark: SparkSession, forest: RandomForestClassifier, trees: Trees, thresholds: list[np.ndarray]) -> RandomForestClassificationModel:
    """MLlib's model with these trees, by way of the form in which it stores them."""
    count, labels = trees.feature.shape[0], trees.counts.shape[2]
    nodes = [{"treeID": tree, "nodeData": row} for tree in range(count) for row in trees.rows(tree, thresholds)]
    with dropped(spark, scratch_path(spark, "forest-nodes")) as path:
        spark.createDataFrame(pa.Table.from_pylist(nodes, schema=NODES)).write.parquet(f"{path}/data")
        facts = {"numFeatures": len(thresholds), "numClasses": labels}
        one = write_metadata(spark, None, forest, "DecisionTreeClassificationModel", facts, ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap"))
        spark.createDataFrame([(tree, one, 1.0) for tree in range(count)], "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
        write_metadata(spark, path, forest, "RandomForestClassificationModel", facts | {"numTrees": count})
        return RandomForestClassificationModel.load(path)


def fit_binned(forest: RandomForestClassifier, rows: DataFrame, total: int, label_index: str, features: Sequence[str], labels: int, scaling: Scaling, block_rows: int = BLOCK_ROWS) -> RandomForestClassificationModel:
    """The forest fitted on all `rows`, of which there are `total`, with the features scaled as the model will get them."""
    spark, seed, depth = rows.sparkSession, forest.getSeed() & (2**63 - 1), forest.getMaxDepth()
    thresholds = candidates(rows, total, features, scaling, min(forest.getMaxBins(), total), forest.getSeed())
    width, bins, per_node = len(features), max(2, 1 + max(len(t) for t in thresholds)), chosen_per_node(forest, len(features))

    def encode(columns: np.ndarray) -> bytes:
        scaled = scaling.apply(columns)
        return np.column_stack([t.searchsorted(values).astype(np.uint8) for t, values in zip(thresholds, scaled)]).tobytes()

    trees = Trees.empty(forest.getNumTrees(), depth, labels)
    random = np.random.default_rng([seed, 1])
    with packed(rows, label_index, features, encode, block_rows) as blocks:
        waiting = [np.zeros(1, np.intp)] * forest.getNumTrees()
        for level in range(depth):
            chosen = [random.random((len(places), width)).argsort(axis=1)[:, :per_node].astype(np.int32) for places in waiting]
            if not any(map(len, chosen)):
                break
            frontier = trees.frontier(level, waiting, chosen, bins)
            counted = blocks.mapInArrow(counting(frontier, width, bins, labels, seed), COUNTED)
            best = best_splits(chosen, bins, labels, forest.getMinInstancesPerNode(), forest.getMinInfoGain())
            waiting = trees.grow(level, waiting, counted.groupBy("tree", "low").applyInArrow(best, FOUND).toArrow())
    return as_model(spark, forest, trees, thresholds)
