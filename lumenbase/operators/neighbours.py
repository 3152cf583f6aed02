"""Neighbour graphs of whole tables of vectors: all pairs by matrix products up to ``EXACT`` nodes, else hashed blocks and NN-descent.

Distinct vectors are nodes, numbered by the hash of the vector, so copies cost nothing and results do not depend on the
partitioning. Up to ``EXACT`` nodes a task asks for some of them and streams all others past these, which is exact and takes less time than
descending. Beyond, random planes through the mean cut the nodes into blocks; a block that is still too large is cut by hash. Each node
gets its nearest in its blocks, and rounds of NN-descent mend what the cuts part: the neighbours of a node, forwards and
backwards, are compared with each other, and pairs nearer than what either has replace it. There no step compares all with all: a
block has ``BLOCK`` nodes, a node at most twice ``MOST`` others that it introduces to each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..session import dropped, written

#: Nodes of a block that are compared all with all, cuts into blocks, neighbours that a node introduces to each other in a round, each way.
BLOCK, TABLES, MOST = 8192, 4, 30
#: Nodes up to which all pairs are compared; nodes that a task asks for, at least and at most; nodes that it compares with these at once, at least and at most.
EXACT, ASKED, TILE = 1 << 20, (1024, 16_384), (1024, 8192)
#: Share of both squares by which a product of floats may miss a squared distance (some 66 terms, each rounded).
SLACK = 1.6e-5
EDGES = "node long, other long, d double"


def node_of(vector: str) -> Column:
    """The number of a vector's node; null for vectors that are null or empty or hold null."""
    v = F.col(vector).cast("array<double>")
    return F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), F.xxhash64(v))


def nodes(rows: DataFrame, vector: str, metric: str = "euclidean") -> DataFrame:
    """(node, v): each distinct vector once, at length one for the cosine metric."""
    # vectors of floats stay so, which halves what is shuffled
    kind = "array<float>" if rows.select(vector).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    found = rows.select(node_of(vector).alias("node"), F.col(vector).cast(kind).alias("v")).where("node is not null").dropDuplicates(["node"])
    return found if metric == "euclidean" else found.select("node", V.unit(F.col("v").cast("array<double>")).cast(kind).alias("v"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all of y."""
    d = (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(d, 0))


def _nearest(node: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, other, d) of the k nearest of each node among the others."""
    out = []
    k = min(k, len(node) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(node), 512):
        d = _distances(v[at : at + 512], v)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        # the distances kept are summed from differences, which cancel nothing
        exact = np.sqrt(((v[at : at + len(d), None] - v[near]) ** 2).sum(2))
        out.append((np.repeat(node[at : at + len(d)], k), node[near].ravel(), exact.ravel()))
    return tuple(np.concatenate(c) for c in zip(*out))


def _edges(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    return pa.table({"node": found[0], "other": found[1], "d": found[2]})


def _vectors(table: pa.Table, column: str = "v") -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten()
    return np.asarray(flat, np.float64).reshape(table.num_rows, -1)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest others of each node; ties by a hash of both, so that no node is everyone's choice. One shuffle, by node."""
    order = Window.partitionBy("node").orderBy("d", F.xxhash64("node", "other"))
    once = edges.repartition("node").groupBy("node", "other").agg(F.min("d").alias("d"), *[F.min(c).alias(c) for c in edges.columns[3:]])
    return once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _draw(node: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A hash of both, which decides between equal distances."""
    h = node.astype(np.uint64) ^ (other.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


class _Asked:
    """The nearest so far of some nodes, while all nodes pass by in tiles.

    A product of floats with room for its rounding says which pairs may be near enough; their distances are summed from differences in
    doubles, so neither the tiles nor their order show in the result."""

    ROWS = 256

    def __init__(self, node: np.ndarray, v: np.ndarray, k: int):
        self.node, self.v, self.k, self.seen = node, v.astype(np.float64), k, 0
        sound = self.v[np.isfinite(self.v).all(1)]
        self.centre = sound.mean(0) if len(sound) else np.zeros(v.shape[1])
        widest = np.sqrt(((sound - self.centre) ** 2).sum(1)).max(initial=0.0)
        self.scale = 2.0 ** -np.frexp(widest)[1] if 0 < widest < np.inf else 1.0
        self.d, self.other = np.full((len(node), k), np.inf), np.zeros((len(node), k), np.int64)

    def see(self, node: np.ndarray, v: np.ndarray) -> None:
        at = 0
        while at < len(node):  # a short tile first, which bounds what others bring
            tile = slice(at, at := at + min(max(TILE[0], self.seen), TILE[1]))
            self.meet(node[tile], v[tile])
            self.seen += len(node[tile])

    def meet(self, node: np.ndarray, v: np.ndarray) -> None:
        v = v.astype(np.float64)
        near = (v - self.centre) * self.scale
        square = (near**2).sum(1)
        # beyond the range of floats the products are of doubles
        kind = np.float32 if square.max(initial=0.0) < 1e30 else np.float64
        right = np.concatenate([near, ((1 - SLACK) * square)[:, None], np.ones((len(v), 1))], axis=1).astype(kind).T
        for at in range(0, len(self.node), self.ROWS):
            rows = slice(at, at + self.ROWS)
            mine = (self.v[rows] - self.centre) * self.scale
            own = (mine**2).sum(1)
            low = np.concatenate([-2 * mine, np.ones((len(mine), 1)), ((1 - SLACK) * own)[:, None]], axis=1).astype(kind) @ right
            worst = (self.d[rows, -1] * self.scale) ** 2
            if np.isinf(worst).any() and len(v) > self.k:  # the node itself may be among the k + 1
                worst = np.minimum(worst, np.partition(low, self.k, axis=1)[:, self.k] + 2 * SLACK * (own + square.max()))
            found = np.flatnonzero(low <= (worst * (1 + 1e-6)).astype(kind)[:, None])
            if len(found):
                self._keep(rows, *np.divmod(found, len(v)), node, v)

    def _keep(self, rows: slice, r: np.ndarray, c: np.ndarray, node: np.ndarray, v: np.ndarray) -> None:
        asked, mine = self.node[rows], self.v[rows]
        other = asked[r] != node[c]
        r, c = r[other], c[other]
        d = np.concatenate([np.zeros(0), *[np.sqrt(((mine[r[s]] - v[c[s]]) ** 2).sum(1)) for s in (slice(at, at + 16_384) for at in range(0, len(r), 16_384))]])
        near = d <= self.d[rows, -1][r]
        r, c, d = r[near], c[near], d[near]
        if not len(r):
            return
        count = np.bincount(r, minlength=len(asked))
        place = self.k + np.arange(len(r)) - (np.cumsum(count) - count)[r]
        all_d, all_other = np.full((len(asked), self.k + count.max()), np.inf), np.zeros((len(asked), self.k + count.max()), np.int64)
        all_d[:, : self.k], all_other[:, : self.k] = self.d[rows], self.other[rows]
        all_d[r, place], all_other[r, place] = d, node[c]
        best = np.argpartition(all_d, self.k - 1, axis=1)[:, : self.k]
        last = np.take_along_axis(all_d, best, 1).max(1)
        for i in np.flatnonzero(((all_d <= last[:, None]).sum(1) > self.k) & np.isfinite(last)):
            best[i] = np.lexsort((_draw(asked[i], all_other[i]), all_d[i]))[: self.k]
        all_d, all_other = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_other, best, 1)
        order = np.lexsort((_draw(asked[:, None], all_other), all_d), axis=1)
        self.d[rows], self.other[rows] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_other, order, 1)

    def edges(self) -> Iterator[pa.RecordBatch]:
        step = max(1, 500_000 // self.k)
        for at in range(0, len(self.node), step):
            there = np.isfinite(self.d[at : at + step])
            node = np.repeat(self.node[at : at + step], there.sum(1))
            yield from _edges((node, self.other[at : at + step][there], self.d[at : at + step][there])).to_batches()


def all_pairs(table: DataFrame, n: int, k: int) -> DataFrame:
    """EDGES of the k nearest others of each of ``n`` nodes: a task asks for its part of them, and all nodes pass by."""
    parts = math.ceil(n / min(max(n // 32, ASKED[0]), ASKED[1]))
    kind = np.float32 if table.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    k = min(k, n - 1)

    def pack(batches):
        for batch in batches:
            node = np.asarray(batch.column(0))
            v = np.asarray(batch.column(1).flatten(), kind).reshape(len(node), -1)
            for p in np.unique(node % parts):
                rows = np.flatnonzero(node % parts == p)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([node[rows].tobytes()], pa.binary()), pa.array([v[rows].tobytes()], pa.binary())], ["part", "nodes", "vectors"])

    def rows(batches):
        for batch in batches:
            for own, a, b in zip(*(batch.column(c) for c in ("own", "nodes", "vectors"))):
                node = np.frombuffer(a.as_buffer(), np.int64)
                yield own.as_py(), node, np.frombuffer(b.as_buffer(), kind).reshape(len(node), -1)

    def search(batches):
        asked, held = None, []
        joined = lambda: [np.concatenate(c) for c in zip(*held)]
        for own, node, v in rows(batches):
            if not own and asked is None:
                if not held:  # nobody asks here
                    return
                asked = _Asked(*joined(), k)
            if asked and sum(len(x) for x, _ in held) >= TILE[1]:
                asked.see(*joined())
                held = []
            held.append((node, v))
        if held:
            asked = asked or _Asked(*joined(), k)
            asked.see(*joined())
        if asked:
            yield from asked.edges()

    packed = table.select("node", "v").mapInArrow(pack, "part int, nodes binary, vectors binary")
    dealt = packed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionById(parts, F.col("task"))
    return dealt.select((F.col("part") == F.col("task")).alias("own"), "nodes", "vectors").sortWithinPartitions(F.col("own").desc()).mapInArrow(search, EDGES)


def in_blocks(table: DataFrame, k: int, seed: int, block: int, tables: int = TABLES) -> DataFrame:
    """EDGES of the k nearest inside hashed blocks; exact if all nodes fit one block."""
    n = table.count()
    bits = max(0, math.ceil(math.log2(max(1, 2 * n / block)))) if n > block else 0
    means = table.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    centre = np.array([r["m"] for r in means])

    def cut(batches):
        rng = np.random.default_rng(seed)
        planes = rng.standard_normal((tables, len(centre), bits)) if bits else None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            v = _vectors(t) - centre
            for i in range(tables if bits else 1):
                place = ((v @ planes[i] > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(place), *batch.columns], ["t", "place", "node", "v"])

    dealt = table.select("node", "v").mapInArrow(cut, f"t int, place long, node long, v {table.schema['v'].dataType.simpleString()}")
    # a block beyond its size is cut by hash: each row knows how many parts its block has
    sizes = dealt.groupBy("t", "place").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = dealt.join(sizes, ["t", "place"]).withColumn("part", F.expr(f"cast(pmod(xxhash64({seed}, t, node), parts) as int)"))

    def near(key, group):
        node = np.asarray(group.column("node"))
        order = np.argsort(node)
        return _edges(_nearest(node[order], _vectors(group)[order], k))

    return _best(dealt.select("t", "place", "part", "node", "v").groupBy("t", "place", "part").applyInArrow(near, EDGES), k)


def _met(node: np.ndarray, worst: np.ndarray, fresh: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, other, d) of what the members of some centres, each a row of ``node``, bring each other; at most k for a node."""
    square = (v**2).sum(2)
    d = square[:, :, None] + square[:, None] - 2 * v @ v.transpose(0, 2, 1)
    meets = fresh[:, :, None] | fresh[:, None]
    meets[:, np.arange(node.shape[1]), np.arange(node.shape[1])] = False
    # a little room for what the product cancels; the distances kept are summed from differences
    c, i, j = np.nonzero(meets & (d < (worst**2)[:, :, None] + 1e-9 * (1 + square[:, :, None] + square[:, None])))
    exact = np.concatenate([np.sqrt(((v[c[s], i[s]] - v[c[s], j[s]]) ** 2).sum(1)) for s in (slice(at, at + 100_000) for at in range(0, len(c), 100_000))]) if len(c) else np.zeros(0)
    near = exact < worst[c, i]
    a, b, exact = node[c, i][near], node[c, j][near], exact[near]
    order = np.lexsort((b, exact, a))
    a, b, exact = a[order], b[order], exact[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, exact = a[once], b[once], exact[once]
    first = np.searchsorted(a, a, "left")
    keep = np.arange(len(a)) - first < k
    return a[keep], b[keep], exact[keep]


def _whole_groups(batches):
    """Tables of whole centres from batches sorted by centre; the last of a batch goes on in the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        centre = np.asarray(held.column("centre"))
        done = int(np.searchsorted(centre, centre[-1], "left"))
        if done:
            yield held.slice(0, done)
            held = held.slice(done)
    if held is not None:
        yield held


def descend(table: DataFrame, graph: DataFrame, k: int, seed: int) -> DataFrame:
    """One round of NN-descent: EDGES with what neighbours of neighbours bring, and ``fresh``, whether an edge has not introduced its ends
    to others yet (all, if ``graph`` does not say). Only pairs of which one is fresh to their centre are compared. A centre introduces up to
    ``MOST`` neighbours forwards and as many backwards, fresh ones first."""
    draw = lambda *c: F.xxhash64(F.lit(seed), *c)
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("fresh").desc(), draw("node", "other")))
    most = min(k, MOST)
    graph = graph if "fresh" in graph.columns else graph.withColumn("fresh", F.lit(True))
    if k > MOST:
        graph = graph.withColumn("_picked", first("node") <= most)
    else:
        graph = graph.withColumn("_picked", F.lit(True))
    picked = graph.where("_picked")
    # backward neighbours: first among 16 parts of a crowd, then among what these keep
    back = picked.withColumn("_r", first("other", F.pmod(F.col("node"), F.lit(16)))).where(F.col("_r") <= most)
    back = back.withColumn("_r", first("other")).where(F.col("_r") <= most)
    lists = picked.select(F.col("node").alias("centre"), F.col("other").alias("member"), "fresh").union(back.select("other", "node", "fresh"))
    lists = lists.union(table.select("node", "node", F.lit(False))).repartition("centre").groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    lists = lists.withColumn("_any", F.max("fresh").over(Window.partitionBy("centre"))).where("_any").drop("_any")
    worst = graph.groupBy("node").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
    members = table.join(worst, "node", "left").select(F.col("node").alias("member"), "v", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(float("inf"))).alias("worst"))

    def meet(batches):
        for t in _whole_groups(batches):
            centre, node, worst, fresh = (np.asarray(t.column(c)) for c in ("centre", "member", "worst", "fresh"))
            v = _vectors(t)
            start = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
            size = np.diff(np.append(start, len(centre)))
            found = []
            for m in np.unique(size):
                of = start[size == m]
                step = max(1, 2_000_000 // int(m * m))
                for at in range(0, len(of), step):
                    rows = of[at : at + step, None] + np.arange(m)
                    found.append(_met(node[rows], worst[rows], fresh[rows], v[rows], k))
            yield from _edges(tuple(np.concatenate(c) for c in zip(*found))).combine_chunks().to_batches()

    met = lists.join(members, "member").repartition("centre").sortWithinPartitions("centre").mapInArrow(meet, EDGES)
    kept = graph.select("node", "other", "d", (F.col("fresh") & ~F.col("_picked")).alias("fresh"))
    return _best(kept.union(met.withColumn("fresh", F.lit(True))), k)


def graph(table: DataFrame, k: int, seed: int = 42, block: int | None = None, rounds: int = 6, least: float = 0.002) -> DataFrame:
    """EDGES of the k nearest others of each node of ``table`` (node, v): of all pairs up to ``EXACT`` nodes. For more, or if ``block``
    is given, about the k nearest by blocks of that size and rounds that end when few edges change."""
    table = written(table)
    n = table.count()
    if block is None and n <= EXACT:
        return written(all_pairs(table, n, k) if n > 1 else table.where("false").selectExpr("node", "node as other", "0D as d"))
    block = block or BLOCK
    edges = written(in_blocks(table, k, seed, block))
    if n <= block:
        return edges
    total = edges.count()
    for turn in range(rounds):
        after = written(descend(table, edges, k, seed + 1 + turn))
        changed = after.join(edges.select("node", "other"), ["node", "other"], "left_anti").count()
        dropped(edges)
        edges = after
        if changed <= least * total:
            break
    return edges.select("node", "other", "d")
