"""Canvas versions and node/edge graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, written
from .integrity import paired


def latest(versions: DataFrame, by: str, order: str) -> DataFrame:
    """The last row of each key; an aggregate, so it combines before the shuffle."""
    others = [c for c in versions.columns if c != by]
    return versions.groupBy(by).agg(F.max_by(F.struct(*others), order).alias("_r")).select(by, "_r.*")


def compacted(saves: DataFrame, by: str, order: str, content: str) -> DataFrame:
    """(by, version_at, saved_at, content): consecutive saves of equal content are one version, named by its first
    save and stamped by its last."""
    w = Window.partitionBy(by).orderBy(order)
    changed = F.coalesce((~F.col(content).eqNullSafe(F.lag(content).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    run = F.sum(F.when(first, 1).otherwise(changed)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = saves.select(by, order, content, run.alias("_run"))
    return marked.groupBy(by, "_run").agg(F.min(order).alias("version_at"), F.max(order).alias("saved_at"), F.first(content).alias(content)).drop("_run")


def next_id(rows: DataFrame, column: str, separator: str = "-") -> DataFrame:
    """(next_id): one more than the largest number after the separator; 0 without rows, junk counts as 0."""
    tail = F.substring_index(column, separator, -1)
    return rows.agg((F.coalesce(F.max(F.coalesce(tail.try_cast("int"), F.lit(0))), F.lit(-1)) + 1).alias("next_id"))


def nested(parents: DataFrame, children: DataFrame, key: str, child: list[str], name: str) -> DataFrame:
    """Parents with an array of their children's columns, sorted; empty without children."""
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*child))).alias(name))
    kind = grouped.schema[name].dataType
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def without_node(edges: DataFrame, node: str) -> DataFrame:
    """Edges (source, target) after a node goes: those that touch it are replaced by its incomers x outgoers."""
    return without_nodes(edges, edges.sparkSession.createDataFrame([(node,)], "node string"))


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target) after all ``nodes`` (node) have gone, one after another in whatever order.

    A path that leads only through nodes that go becomes an edge. Which of them reach each other is found by doubling: a round joins
    the paths found so far with themselves, so a chain of length n takes log n rounds."""
    gone = nodes.select("node").distinct()
    e = edges.select("source", "target").distinct()
    is_gone = lambda c: gone.select(F.col("node").alias(c))
    into = e.join(is_gone("target"), "target", "left_semi").join(is_gone("source"), "source", "left_anti")
    out = e.join(is_gone("source"), "source", "left_semi").join(is_gone("target"), "target", "left_anti")
    within = e.join(is_gone("target"), "target", "left_semi").join(is_gone("source"), "source", "left_semi").select("source", "target").where("source <> target")
    paths, before = written(within), -1
    while (count := paths.count()) != before and count:
        longer = paths.select("source", F.col("target").alias("via")).join(paths.select(F.col("source").alias("via"), "target"), "via").select("source", "target")
        before, old = count, paths
        paths = written(paths.union(longer.where("source <> target")).distinct())
        dropped(old)
    reach = paths.union(gone.select(F.col("node").alias("source"), F.col("node").alias("target")))
    there = into.select("source", F.col("target").alias("first")).join(reach.select(F.col("source").alias("first"), F.col("target").alias("last")), "first").select("source", "last").distinct()
    made = there.join(out.select(F.col("source").alias("last"), "target"), "last").select("source", "target")
    kept = e.join(is_gone("source"), "source", "left_anti").join(is_gone("target"), "target", "left_anti").select("source", "target")
    return kept.union(made).distinct()


def bridged(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(via, source, target): new edges around each of these nodes, by joining the edges on the node."""
    into = edges.join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select("source", F.col("target").alias("via"))
    out = edges.select(F.col("source").alias("via"), "target")
    return into.join(out, "via").where("source <> via and target <> via").distinct()


def merged_nodes(nodes: DataFrame, by: str, drop: float = 210.0) -> DataFrame:
    """One node for each group: content joined in order (pos), mean position moved down."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda e: e["content"]), " ")
    return nodes.groupBy(by).agg(text.alias("content"), F.avg("x").alias("x"), (F.avg("y") + drop).alias("y"))


def parent_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (parent, child) both ends of which exist."""
    ids = nodes.select("id")
    return links.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("id", "child"), "child", "left_semi").select("parent", "child")


def pasted(nodes: DataFrame, suffix: str) -> tuple[DataFrame, DataFrame]:
    """Copies of nodes (id, x, y, n) with new ids and an offset of 10 (n + 1), and edges from old to new."""
    new = F.concat("id", F.lit(suffix))
    step = 10 * (F.col("n") + 1)
    return nodes.select(new.alias("id"), (F.col("x") + step).alias("x"), (F.col("y") + step).alias("y")), nodes.select(F.col("id").alias("source"), new.alias("target"))


def version_map(versions: DataFrame, by: str, at: str, blob: str) -> DataFrame:
    """(by, versions): all versions of a canvas as a map from time to content."""
    return versions.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(at, blob)))).alias("versions"))


def clipping_added(users: DataFrame, additions: DataFrame) -> DataFrame:
    """Users (userId, clippings) with a clipping appended unless an equal one is there."""
    add = additions.groupBy("userId").agg(F.array_sort(F.collect_set("clipping")).alias("_add"))
    out = F.concat("clippings", F.array_except("_add", "clippings"))
    return users.join(add, "userId", "left").withColumn("clippings", F.when(F.col("_add").isNull(), F.col("clippings")).otherwise(out)).drop("_add")


def overlapping(boxes: DataFrame, key: str, kind: str, cell: float) -> DataFrame:
    """(a, b): boxes (x, y, w, h) of one kind that overlap, a < b. Boxes are listed in the grid cells they touch and
    joined by cell, crowded cells in parts; a pair is taken in the one cell that holds its overlap's lower corner."""
    cells = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell))
    listed = boxes.withColumn("cx", F.explode(cells("x", "w"))).withColumn("cy", F.explode(cells("y", "h")))
    left, right, _ = paired(listed, [kind, "cx", "cy"], key)
    a = left.select(kind, "cx", "cy", "_part", F.col(key).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("w").alias("aw"), F.col("h").alias("ah"))
    b = right.select(kind, "cx", "cy", "_part", F.col(key).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    hit = a.join(b, [kind, "cx", "cy", "_part"]).where("a < b and ax < bx + bw and bx < ax + aw and ay < by + bh and by < ay + ah")
    own = (F.floor(F.greatest("ax", "bx") / cell) == F.col("cx")) & (F.floor(F.greatest("ay", "by") / cell) == F.col("cy"))
    return hit.where(own).select(kind, "a", "b")


def distinct_clippings(rows: DataFrame, owner: str, content: str, order: str) -> DataFrame:
    """(owner, content, order): each content once for an owner, where it first stands."""
    return rows.groupBy(owner, content).agg(F.min(order).alias(order))


def nearby(boxes: DataFrame, key: str, seed: int, padding: float = 10.0) -> DataFrame:
    """(key, x, y): a place just below each box (key, x, y, width, height), moved by up to 30 to the right or down and 10 back, by its key and the seed."""
    move = lambda i: F.pmod(F.xxhash64(F.lit(seed + i), key), F.lit(1 << 20)) / F.lit(float(1 << 20)) * 40 - 10
    x = F.col("x") + F.col("width") / 2 - padding + move(0)
    return boxes.select(key, x.alias("x"), (F.col("y") + F.col("height") + padding + move(1)).alias("y"))
