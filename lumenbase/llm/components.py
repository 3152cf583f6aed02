"""Connected components of an edge table by contraction inside tasks and alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Nodes that a task holds before it writes its forest and starts another.
MOST_NODES = 1 << 20


def forest(batches):
    """Spanning forests of this partition's edges, each node linked to the smallest of its tree. A forest of more than
    MOST_NODES nodes is written and forgotten, so memory is bounded; later rounds connect what two forests share."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def rows():
        nodes = [n for n in parent if root(n) != n]
        for i in range(0, len(nodes), 1 << 16):
            part = nodes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([parent[n] for n in part], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > MOST_NODES:
            yield from rows()
            parent.clear()
    yield from rows()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, contracted: bool = False) -> DataFrame:
    """(node, root): every node of ``edges`` (a long, b long) with the smallest node of its component.

    Edges that ``forest`` has been applied to already, in the task that found them, are ``contracted``.
    Edges never leave the executors; each round is written to the shared folder, so a lost executor costs one round.
    Rounds end when the edge set no longer changes, which is when every edge points to its root.
    """
    spark = edges.sparkSession
    current = written(edges if contracted else edges.where("a <> b").mapInArrow(forest, "a long, b long"))
    before = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        after = written(_small_star(_large_star(current)))
        dropped(current)
        current = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots) if before else spark.createDataFrame([], "node long, root long")


