"""Connected components: of a table of links by hooking every node to its smallest neighbour, and of a task's own links in arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.tables import stored


def roots(parents: DataFrame) -> DataFrame:
    """Follow node -> parent (always smaller) to the end, doubling the step: node, parent."""
    while True:
        further = parents.alias("x").join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("beyond")), "parent", "left")
        jumped = stored(further.select("node", F.coalesce("beyond", "parent").alias("parent"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if jumped.filter("moved").isEmpty():
            return jumped.select("node", "parent")
        parents = jumped.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for every node of the links (a, b); a stored table.

    In each round a node takes its smallest neighbour as parent if that is smaller than itself, chains of
    parents are followed to their ends, and links are rewritten between these ends. Links inside a tree
    vanish, so what remains shrinks by more than half of its nodes each round.
    """
    open_links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = stored(open_links.select(F.col("a").alias("node")).union(open_links.select("b")).distinct().select("node", F.col("node").alias("label")), "labels")
    while not open_links.isEmpty():
        parents = stored(open_links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents")
        root = roots(parents)
        labels = stored(labels.join(root.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        left = open_links.join(root.select(F.col("node").alias("a"), F.col("parent").alias("root_a")), "a", "left")
        both = left.join(root.select(F.col("node").alias("b"), F.col("parent").alias("root_b")), "b", "left")
        ends = both.select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")).filter("x <> y")
        open_links = stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels


def least_connected(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n places the least place that the links connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if (label == before).all():
            return label
