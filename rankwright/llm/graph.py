"""Connected components by randomised contraction, all in tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.llm.common import attach_groups, cut

#: Links up to so many (16 MB) are joined up by one task.
LOCAL = 1 << 20


class Roots:
    """Union-find with path halving; the smallest node is the root."""

    def __init__(self) -> None:
        self._up: dict[int, int] = {}

    def of(self, x: int) -> int:
        up = self._up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.of(a), self.of(b)
        self._up[max(a, b)] = min(a, b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return ((x, self.of(x)) for x in list(self._up))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roots = Roots()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            roots.join(a, b)
    nodes, labels = zip(*found) if (found := list(roots)) else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], names=("node", "label"))


def _contracted(edges: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round: every node goes to that of its closed neighbourhood which comes first in a random order of this round."""
    rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))
    total = 2 * edges.count()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    step = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("_b"), F.count(F.lit(1)).alias("_n"))
    step = cut(step.select("a", F.when(rank("a") < rank("_b"), F.col("a")).otherwise(F.col("_b")).alias("to"), "_n"), "step")
    labels = labels.join(step.select(F.col("a").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    moved = attach_groups(edges, step, "a", "_n", total).select(F.col("to").alias("x"), F.col("b").alias("a"))
    moved = attach_groups(moved, step, "a", "_n", total).select("x", F.col("to").alias("y"))
    moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return cut(moved, "links"), cut(labels, "labels")


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is a node id, the same within a component.

    While there are more than ``local`` links, rounds of contraction under a
    fresh random order shrink the nodes; whatever the graph, a path in id order
    included, at most three quarters of them are left on average, so rounds
    number O(log n). Then one task joins up the rest, which is at most ``local``
    pairs of ids. Every round is a written table.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels, turn = None, 0
    while edges.count() > local:
        if labels is None:
            labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
        edges, labels = _contracted(edges, labels, turn)
        turn += 1
    last = cut(edges.coalesce(1).mapInArrow(_joined, "node long, label long"), "labels")
    if labels is None:
        return last
    last = last.withColumnRenamed("label", "to").withColumnRenamed("node", "label")
    return cut(labels.join(last, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
