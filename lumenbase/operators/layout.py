"""Maps of vectors in two dimensions by their neighbours: UMAP and t-SNE.

Both start from a neighbour graph (``neighbours.graph``), make it a weighted symmetric edge table, and then move the nodes in
blocks. Blocks are cut by quantiles of the first two principal components, so most edges stay inside one; a task holds the edges
of its nodes and the positions of the nodes that they reach, moves its own nodes for some epochs and returns them; the others
stand still until the next round. A map of one block needs one round. Edges and positions never reach the driver; what does are
the quantiles and, for t-SNE on several blocks, a grid of bounded size. t-SNE, which has the most edges, keeps them packed, a few rows
a block, and its blocks send each other the positions that are reached.

Equal vectors are one node and get one position; rows whose vector is null, empty or holds null get none. Results are scaled to the
unit box. Everything is drawn from the seed, the node and the epoch, not from the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bucketed, dropped, written
from . import neighbours
from .maps import pca_layout
from .retrieval import minmax

#: Nodes of a block (of t-SNE, whose nodes have six times the edges, so that each reaches fewer blocks), positions that stand for all others, epochs of a round where there are several blocks, grid intervals a side at most.
BLOCK, TSNE_BLOCK, POOL, EPOCHS, INTERVALS = 4096, 16_384, 4096, 10, 320
#: Buckets of the edges at most; with more blocks than these some share one.
MOST_BUCKETS = 4096
_STATE = "node long, block int, x double, y double, vx double, vy double, gx double, gy double"
_LINKS = "node long, other long, w double"


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^2b) nearest to 1 up to ``min_dist`` and an exponential beyond, by Gauss-Newton with damping."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([0.0, 0.0]), 1e-3  # logarithms of a and b
    value = lambda p: 1 / (1 + np.exp(p[0]) * x ** (2 * np.exp(p[1])))
    for _ in range(200):
        f = value(p)
        u = np.exp(p[0]) * x ** (2 * np.exp(p[1]))
        jac = np.stack([-(f**2) * u, -(f**2) * u * 2 * np.exp(p[1]) * np.log(x)], axis=1)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(2), jac.T @ (y - f))
        better = ((y - value(p + step)) ** 2).sum() < ((y - f) ** 2).sum()
        p, damp = (p + step, damp / 3) if better else (p, damp * 4)
    return float(np.exp(p[0])), float(np.exp(p[1]))


def _per_node(edges: DataFrame, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """_LINKS: the distances of each node's neighbours, nearest first, weighed together; nodes have at most k of them."""

    def weights(batches):
        for batch in batches:
            ends = np.asarray(batch.column(1).value_lengths()).astype(np.int64)
            for n in np.unique(ends):
                rows = np.flatnonzero(ends == n)
                part = batch.take(pa.array(rows))
                lists = part.column(1).flatten()
                d, other = np.asarray(lists.field(0)).reshape(-1, n), np.asarray(lists.field(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column(0)), n)), pa.array(other), pa.array(weigh(d).ravel())], ["node", "other", "w"])

    lists = edges.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("d", "other"))).alias("near"))
    return lists.mapInArrow(weights, _LINKS)


def smooth_weights(d: np.ndarray, rounds: int = 64) -> np.ndarray:
    """UMAP's membership of each neighbour: exp(-(d - nearest) / sigma), where the sum over a node is log2 of its neighbours."""
    goal = np.log2(d.shape[1] + 1)
    nearest = np.where((d > 0).any(1), np.where(d > 0, d, np.inf).min(1), 0.0)
    over = np.maximum(d - nearest[:, None], 0)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(rounds):
        much = np.exp(-over / sigma[:, None]).sum(1) > goal
        high[much], low[~much] = sigma[much], sigma[~much]
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    return np.exp(-over / np.maximum(np.maximum(sigma, 1e-3 * d.mean(1)), 1e-300)[:, None])


def perplexity_weights(d: np.ndarray, perplexity: float, rounds: int = 64) -> np.ndarray:
    """t-SNE's conditional probabilities: each row sums to one, with the entropy of so many neighbours."""
    square = d**2 - (d**2).min(1)[:, None]
    goal = math.log(min(perplexity, d.shape[1]))
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(rounds):
        p = np.exp(-square * beta[:, None])
        total = p.sum(1)
        entropy = np.log(total) + beta * (square * p).sum(1) / total
        flat = entropy > goal
        low[flat], high[~flat] = beta[flat], beta[~flat]
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = np.exp(-square * beta[:, None])
    return p / p.sum(1)[:, None]


def fuzzy_union(links: DataFrame) -> DataFrame:
    """_LINKS both ways with w = a + b - ab of the two directions."""
    both = links.union(links.select(F.col("other").alias("node"), F.col("node").alias("other"), "w"))
    s = both.groupBy("node", "other").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    return s.select("node", "other", (F.col("s") - (F.col("s") * F.col("s") - F.col("q")) / 2).alias("w"))


def joint(links: DataFrame, n: int) -> DataFrame:
    """_LINKS both ways with t-SNE's joint probabilities, which sum to one."""
    both = links.union(links.select(F.col("other").alias("node"), F.col("node").alias("other"), "w"))
    return both.groupBy("node", "other").agg((F.sum("w") / (2 * n)).alias("w"))


def _placed(table: DataFrame, n: int, spread: float, block: int, seed: int) -> tuple[DataFrame, int]:
    """_STATE at the principal components, so scaled that the wider spans ``spread``, and the number of blocks."""
    start = pca_layout(table, "node", "v", unit_box=False)
    width = start.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0] or 1.0
    # a little noise parts equal places
    noise = lambda i: (F.pmod(F.xxhash64(F.lit(seed + i), "node"), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5) * (1e-4 * spread)
    # rounded, so that the order in which components were summed makes no difference
    start = written(start.select("node", *[(F.round(F.col(c) / width, 6) * spread + noise(i)).alias(c) for i, c in enumerate("xy")]))
    strips = max(1, math.ceil(math.sqrt(n / block)))
    cells = max(1, math.ceil(n / block / strips))
    cuts = lambda parts: [i / parts for i in range(1, parts)]
    if strips * cells == 1:
        placed = start.withColumn("block", F.lit(0))
    else:
        by_x = start.agg(F.percentile_approx("x", cuts(strips) or [0.5], 10_000).alias("at")).first()["at"] if strips > 1 else []
        place = lambda at, c: F.size(F.filter(at, lambda e: e < F.col(c)))
        placed = start.withColumn("strip", place(F.array(*[F.lit(v) for v in by_x]), "x") if by_x else F.lit(0))
        rows = placed.groupBy("strip").agg(F.percentile_approx("y", cuts(cells) or [0.5], 10_000).alias("at"))
        within = place(F.col("at"), "y") if cells > 1 else F.lit(0)
        placed = placed.join(F.broadcast(rows), "strip").withColumn("block", F.col("strip") * cells + within)
    zero, one = F.lit(0.0), F.lit(1.0)
    return written(placed.select("node", F.col("block").cast("int").alias("block"), "x", "y", zero.alias("vx"), zero.alias("vy"), one.alias("gx"), one.alias("gy"))), strips * cells


class _Block:
    """One block's nodes and edges in a task, by positions in arrays: own nodes first, then those that only edges reach."""

    def __init__(self, edges: pa.Table, states: pa.Table):
        own = np.asarray(states.column("own"))
        node = np.asarray(states.column("node"))
        order = np.lexsort((node, ~own))
        self.node, self.own = node[order], int(own.sum())
        self.state = {c: np.asarray(states.column(c))[order].copy() for c in ("x", "y", "vx", "vy", "gx", "gy")}
        self.at = np.stack([self.state["x"], self.state["y"]], axis=1)
        by = np.argsort(self.node)
        find = lambda ids: by[np.searchsorted(self.node[by], np.asarray(edges.column(ids)))]
        head, tail, w = find("node"), find("other"), np.asarray(edges.column("w"))
        order = np.lexsort((self.node[tail], self.node[head]))
        self.head, self.tail, self.w = head[order], tail[order], w[order]

    def result(self, block: int, **columns) -> pa.Table:
        n = self.own
        values = {"node": self.node[:n], "block": np.full(n, block, np.int32), "x": self.at[:n, 0], "y": self.at[:n, 1]}
        return pa.table(values | {c: columns.get(c, self.state[c])[:n] for c in ("vx", "vy", "gx", "gy")})


def _round(state: DataFrame, links: DataFrame, reach: DataFrame, move: Callable[[int, _Block], pa.Table]) -> DataFrame:
    """``state`` after each block has moved its nodes. Links lie in buckets of their blocks, so only positions are shuffled."""
    none = [F.lit(None).cast("double").alias(c) for c in ("vx", "vy", "gx", "gy")]
    others = reach.join(state.select("node", "x", "y"), "node").select(F.explode("reaches").alias("block"), "node", "x", "y", *none, F.lit(False).alias("own"))
    seen = state.select("block", "node", "x", "y", "vx", "vy", "gx", "gy", F.lit(True).alias("own")).union(others)

    def apply(key, edges, states):
        return move(key[0].as_py(), _Block(edges, states))

    moved = links.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(apply, _STATE)
    return written(moved)


def _prepared(state: DataFrame, links: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Edges with the block of their node, in a bucket of it, and (node, reaches): the other blocks that need to know a node."""
    home = state.select("node", "block")
    edges = bucketed(links.join(home, "node"), "block", min(blocks, MOST_BUCKETS))
    others = edges.select(F.col("other").alias("node"), F.col("block").alias("reaches")).distinct().join(home, "node").where("reaches <> block")
    return edges, written(others.groupBy("node").agg(F.collect_list("reaches").alias("reaches")))


def umap_epochs(b: _Block, epochs: range, total: int, a: float, bb: float, top: float, pool: np.ndarray, share: float, rng: np.random.Generator, negatives: int = 5) -> None:
    """Edge-sampled epochs: an edge is drawn with probability w / top, its node moves towards the other and away from random ones.

    In an epoch the drawn edges are taken in parts of about as many as there are nodes, so a node moves a little at a time. Both directions
    of an edge are listed and each moves its own node alone, twice as far."""
    at, own = b.at, b.own
    for epoch in epochs:
        alpha = 1 - epoch / total
        drawn = rng.permutation(np.flatnonzero(rng.random(len(b.w)) < b.w / top))
        for part in np.array_split(drawn, max(1, len(drawn) // max(own, 64))):
            head, tail = b.head[part], b.tail[part]
            here = at[head]
            gap = here - at[tail]
            d = (gap**2).sum(1)
            power = np.maximum(d, 1e-12) ** (bb - 1)
            pull = np.where(d > 0, -2 * a * bb * power / (1 + a * power * d), 0)
            move = 2 * np.clip(pull[:, None] * gap, -4, 4)
            inside = rng.random((len(part), negatives)) < share
            others = np.where(inside[..., None], at[rng.integers(0, own, inside.shape)], pool[rng.integers(0, len(pool), inside.shape)] if len(pool) else 0)
            gap = here[:, None] - others
            d = (gap**2).sum(2)
            push = 2 * bb / ((0.001 + d) * (1 + a * np.maximum(d, 1e-12) ** bb))
            move += np.where(d[..., None] > 0, np.clip(push[..., None] * gap, -4, 4), 0).sum(1)
            for i in (0, 1):
                at[:own, i] += alpha * np.bincount(head, move[:, i], own)[:own]


def _joined(rows: DataFrame, key: str, vector: str, state: DataFrame) -> DataFrame:
    """(key, x, y) of all rows that have a node, in the unit box."""
    box = minmax(state.select("node", "x", "y"), ["x", "y"], 0.0, 1.0)
    return rows.select(key, neighbours.node_of(vector).alias("node")).join(box, "node").select(key, "x", "y")


def _empty(rows: DataFrame, key: str) -> DataFrame:
    return rows.where("false").select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))


def umap(rows: DataFrame, key: str, vector: str, n_neighbors: int = 15, min_dist: float = 0.1, metric: str = "euclidean", seed: int = 42, epochs: int | None = None, block: int = BLOCK) -> DataFrame:
    """(key, x, y): the UMAP layout of whole vectors in the unit box; at most as many neighbours as there are others."""
    table = written(neighbours.nodes(rows, vector, metric))
    n = table.count()
    if n < 2:
        return _empty(rows, key) if not n else rows.where(neighbours.node_of(vector).isNotNull()).select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    found = neighbours.graph(table, min(n_neighbors, n - 1), seed)
    if metric == "cosine":
        found = found.withColumn("d", F.col("d") * F.col("d") / 2)
    links = written(fuzzy_union(_per_node(found, smooth_weights)))
    top = links.agg(F.max("w")).first()[0]
    epochs = epochs or (500 if n <= 10_000 else 200)
    links = links.where(F.col("w") >= top / epochs)  # an edge that is drawn less than once
    a, b = curve(min_dist)
    state, blocks = _placed(table, n, 20.0, block, seed)
    edges, reach = _prepared(state, links, blocks)
    rounds = 1 if blocks == 1 else -(-epochs // EPOCHS)
    for turn in range(rounds):
        span = range(turn * epochs // rounds, (turn + 1) * epochs // rounds)
        sample = state.orderBy(F.xxhash64(F.lit(seed + turn), "node")).limit(POOL if blocks > 1 else 0).select("x", "y").toArrow()
        pool = np.stack([np.asarray(sample.column(c)) for c in "xy"], axis=1) if sample.num_rows else np.zeros((0, 2))

        def move(block: int, held: _Block, span=span, pool=pool, turn=turn) -> pa.Table:
            umap_epochs(held, span, epochs, a, b, top, pool, 1.0 if blocks == 1 else held.own / n, np.random.default_rng([seed, turn, block]))
            return held.result(block)

        old, state = state, _round(state, edges, reach, move)
        dropped(old)
    dropped(edges)
    return _joined(rows, key, vector, state)


def _smooth(n: int) -> int:
    """The least size from ``n`` on whose prime factors are 2, 3 and 5, which the FFT is quick for."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


class Spectra:
    """The kernels (1 + d^2)^-1 and (1 + d^2)^-2 d between the nodes of a rectangle of interpolation nodes, as products after FFT."""

    def __init__(self, sides: tuple[int, int], step: float):
        self.sides, self.size = sides, tuple(_smooth(2 * n - 1) for n in sides)
        x, y = (np.where((i := np.arange(n)) <= n // 2, i, i - n) * step for n in self.size)
        near = 1 / (1 + x[:, None] ** 2 + y[None, :] ** 2)
        # no two nodes are half of an even size apart, so what stands there is no matter; zero keeps the kernels odd
        x, y = (np.where(np.abs(v) * 2 == n * step, 0.0, v) for v, n in ((x, self.size[0]), (y, self.size[1])))
        self.near = np.fft.rfft2(near).real  # even: real
        near **= 2
        self.x = np.fft.rfft2(near * x[:, None]).imag  # odd: imaginary
        self.y = np.fft.rfft2(near * y[None, :]).imag
        self.twice = np.full(self.near.shape[1], 2.0)  # columns that stand for their mirror too
        self.twice[0] = 1.0
        if self.size[1] % 2 == 0:
            self.twice[-1] = 1.0

    def of(self, charges: np.ndarray) -> np.ndarray:
        return np.fft.fft(np.fft.rfft(charges.reshape(self.sides), self.size[1], axis=1), self.size[0], axis=0)

    def back(self, spectrum: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.ifft(spectrum, axis=0)[: self.sides[0]], self.size[1], axis=1)[:, : self.sides[1]].ravel()

    def forces(self, spectrum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each node the sum of the charges times (1 + d^2)^-2 d, by axis."""
        turned = 1j * spectrum
        return self.back(turned * self.x), self.back(turned * self.y)

    def sums(self, spectrum: np.ndarray) -> np.ndarray:
        """At each node the sum of the charges times (1 + d^2)^-1."""
        return self.back(spectrum * self.near)

    def total(self, spectrum: np.ndarray) -> float:
        """The sum of (1 + d^2)^-1 over all pairs of charges, each with itself too (Parseval)."""
        return float(((spectrum.real**2 + spectrum.imag**2) * self.near).sum(0) @ self.twice) / (self.size[0] * self.size[1])


class Grid:
    """Interpolation nodes over the map: ``POINTS`` a side in each interval, and what charges on them do to each other by FFT."""

    POINTS = 3

    def __init__(self, low: np.ndarray, high: np.ndarray, width: float = 0.4, intervals: int = INTERVALS):
        span = float(max(high - low)) + 1e-9
        cells = int(min(max(30, math.ceil(span / width)), intervals))
        self.low, self.width, self.cells = np.asarray(low, float), span / cells, (cells, cells)
        self.step, self._spectra = self.width / self.POINTS, None

    @property
    def sides(self) -> tuple[int, int]:
        return self.cells[0] * self.POINTS, self.cells[1] * self.POINTS

    @property
    def high(self) -> np.ndarray:
        return self.low + np.array(self.cells) * self.width

    @property
    def spectra(self) -> Spectra:
        if self._spectra is None:
            self._spectra = Spectra(self.sides, self.step)
        return self._spectra

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_spectra": None}  # tasks make what they need

    def within(self, first: np.ndarray, cells: tuple[int, int]) -> Grid:
        """The part of so many intervals from the ``first``."""
        part = Grid.__new__(Grid)
        part.low, part.width, part.cells = self.low + first * self.width, self.width, cells
        part.step, part._spectra = self.step, None
        return part

    def cell(self, at: np.ndarray) -> np.ndarray:
        return np.clip(((at - self.low) / self.width).astype(np.int64), 0, np.array(self.cells) - 1)

    def weights(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position the numbers of the POINTS x POINTS nodes of its interval and their Lagrange weights."""
        cell = self.cell(at)
        inside = (at - self.low) / self.step - cell * self.POINTS - 0.5  # in steps from the interval's first node
        p = np.arange(self.POINTS)
        x, y = (np.stack([np.prod([(v - j) / (i - j) for j in p if i != j], axis=0) for i in p], axis=1) for v in inside.T)
        first = cell * self.POINTS
        number = (first[:, :1] + p)[:, :, None] * self.sides[1] + (first[:, 1:] + p)[:, None, :]
        return number.reshape(len(at), -1), (x[:, :, None] * y[:, None, :]).reshape(len(at), -1)

    def put(self, number: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.bincount(number.ravel(), weight.ravel(), self.sides[0] * self.sides[1])

    def charges(self, at: np.ndarray) -> np.ndarray:
        """What positions put on the grid."""
        return self.put(*self.weights(at))


def repulsion(grid: Grid, at: np.ndarray, others: np.ndarray | float, n_others: int) -> tuple[np.ndarray, float]:
    """Sum over all other positions of (1 + d^2)^-2 times the difference, and Z, the sum over all pairs of (1 + d^2)^-1.

    ``others`` are the charges of positions that are not in ``at``."""
    number, weight = grid.weights(at)
    spectrum = grid.spectra.of(grid.put(number, weight) + others)
    force = np.stack([(f[number] * weight).sum(1) for f in grid.spectra.forces(spectrum)], axis=1)
    return force, grid.spectra.total(spectrum) - (len(at) + n_others)


class Field:
    """What all nodes do at a round's start: on each node of ``grid`` their forces and sums, and their total."""

    def __init__(self, grid: Grid, charges: np.ndarray):
        spectrum = grid.spectra.of(charges)
        self.grid, self.x, self.y, self.sums = grid, *(f.reshape(grid.sides) for f in (*grid.spectra.forces(spectrum), grid.spectra.sums(spectrum)))
        self.total = grid.spectra.total(spectrum)


class Moving:
    """Repulsion of a block's nodes by all, where the others stand as in ``field``: what their own moves change is found by FFT on the
    part of the grid where they are."""

    ROOM = 4  # intervals around the block's nodes

    def __init__(self, field: Field, start: np.ndarray):
        self.field, self.start, self.part = field, start.copy(), None

    def _cut(self, at: np.ndarray) -> None:
        grid, points = self.field.grid, Grid.POINTS
        places = grid.cell(np.concatenate([self.start, at]))
        first = np.maximum(places.min(0) - self.ROOM, 0)
        last = np.minimum(places.max(0) + 1 + self.ROOM, grid.cells)
        self.first, self.last = first, last
        self.part = grid.within(first, tuple(int(n) for n in last - first))
        cut = tuple(slice(a * points, b * points) for a, b in zip(first, last))
        self.x, self.y, self.sums = (f[cut].ravel() for f in (self.field.x, self.field.y, self.field.sums))
        self.before = self.part.charges(self.start)

    def __call__(self, at: np.ndarray, n: int) -> tuple[np.ndarray, float]:
        """As ``repulsion``; ``n`` is the number of all nodes."""
        places = self.field.grid.cell(at)
        if self.part is None or (places.min(0) < self.first).any() or (places.max(0) >= self.last).any():
            self._cut(at)
        number, weight = self.part.weights(at)
        change = self.part.put(number, weight) - self.before
        spectrum = self.part.spectra.of(change)
        force = np.stack([((f + own)[number] * weight).sum(1) for f, own in zip((self.x, self.y), self.part.spectra.forces(spectrum))], axis=1)
        z = self.field.total + 2 * float(change @ self.sums) + self.part.spectra.total(spectrum)
        return force, z - n


def attraction(b: _Block | _Packed) -> np.ndarray:
    """Of each of the block's nodes, over its edges; some edges at a time, which stay in the processor's cache."""
    x, y = (np.ascontiguousarray(b.at[:, i]) for i in (0, 1))
    out = np.zeros((b.own, 2))
    for at in range(0, len(b.head), 1 << 15):
        head, tail = b.head[at : at + (1 << 15)], b.tail[at : at + (1 << 15)]
        gaps = x[head] - x[tail], y[head] - y[tail]
        pull = b.w[at : at + (1 << 15)] / (1 + gaps[0] ** 2 + gaps[1] ** 2)
        first, last = head.min(), head.max() + 1
        for i, gap in enumerate(gaps):
            out[first:last, i] += np.bincount(head - first, pull * gap, last - first)
    return out


def tsne_steps(b: _Block | _Packed, steps: range, early: int, exaggeration: float, rate: float, field: Field | None, n: int) -> dict[str, np.ndarray]:
    """Gradient steps with momentum and gains; ``field`` holds what all nodes do at the start, of which those outside the block stand still."""
    own = b.own
    speed = np.stack([b.state["vx"], b.state["vy"]], axis=1)[:own]
    gain = np.stack([b.state["gx"], b.state["gy"]], axis=1)[:own]
    moving, grid = Moving(field, b.at[:own]) if field else None, None
    for step in steps:
        here = b.at[:own]
        if moving:
            force, z = moving(here, n)
        else:
            low, high = here.min(0), here.max(0)
            # a grid, whose kernels take as long as a step's forces, is kept while the map fills it and fits
            if grid is None or (low < grid.low).any() or (high > grid.high).any() or max(high - low) < 0.8 * max(grid.high - grid.low):
                room = 0.05 * max(high - low) + 1e-6
                grid = Grid(low - room, high + room)
            force, z = repulsion(grid, here, 0.0, n - own)
        gradient = 4 * ((exaggeration if step < early else 1.0) * attraction(b) - force / z)
        same = np.sign(gradient) == np.sign(speed)
        gain = np.maximum(np.where(same, gain * 0.8, gain + 0.2), 0.01)
        speed = (0.5 if step < early else 0.8) * speed - rate * gain * gradient
        b.at[:own] = here + speed
        if field:  # inside the grid, which stays for the round
            b.at[:own] = np.clip(b.at[:own], field.grid.low, field.grid.high)
    return {"vx": speed[:, 0], "vy": speed[:, 1], "gx": gain[:, 0], "gy": gain[:, 1]}


class _Packed:
    """One block's nodes and edges in a task, read from ``_PACKED`` rows: own nodes first, then those that only edges reach."""

    def __init__(self, edges: pa.Table, states: pa.Table):
        rows = sorted([*edges.to_pylist(), *states.to_pylist()], key=lambda r: (r["kind"], r["part"]))
        of = lambda kind, column, dtype: [np.frombuffer(r[column], dtype) for r in rows if r["kind"] == kind]
        joined = lambda arrays, dtype: np.concatenate([np.zeros(0, dtype), *arrays])
        self.node = joined(of(_OWN, "a", np.int64), np.int64)
        self.own = len(self.node)
        own = joined(of(_OWN, "b", np.float64), np.float64).reshape(6, -1)
        self.state = dict(zip(("x", "y", "vx", "vy", "gx", "gy"), own.copy()))
        seen = joined(of(_SEEN, "a", np.float32), np.float32).reshape(-1, 2)
        self.at = np.concatenate([own[:2].T, seen.astype(np.float64)])
        self.head = joined(of(_EDGES, "a", np.int32), np.int64)
        tail = joined(of(_EDGES, "b", np.int32), np.int64)
        self.tail = np.where(tail < 0, self.own - 1 - tail, tail)
        self.w = joined(of(_EDGES, "c", np.float64), np.float64)
        self.sends = [(r["part"], np.frombuffer(r["a"], np.int32)) for r in rows if r["kind"] == _SENDS]

    def result(self, block: int, **columns) -> pa.Table:
        """The block's state and, for each block that reaches some of its nodes, their positions."""
        at = self.at[: self.own]
        state = np.stack([at[:, 0], at[:, 1], *(columns.get(c, self.state[c]) for c in ("vx", "vy", "gx", "gy"))])
        box = [*at.min(0), *at.max(0)] if self.own else [None] * 4
        rows = [(block, _OWN, 0, self.node.tobytes(), state.tobytes(), None, *box)]
        rows += [(to, _SEEN, block, at[which].astype(np.float32).tobytes(), None, None, *[None] * 4) for to, which in self.sends]
        return _packed_rows(rows)


#: Kinds of packed rows. Of a block: its edges (own node, other node or -1 - its number among those that others send, weight); which of its nodes
#: (``a``) it sends to the block ``part``. Of a round: its nodes and their state; positions that the block ``part`` sent.
_EDGES, _SENDS, _OWN, _SEEN = range(4)
_PACKED = "block int, kind int, part int, a binary, b binary, c binary, x0 double, y0 double, x1 double, y1 double"
#: Edges of a packed row.
_ROW_EDGES = 1 << 18


def _packed_rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3 + [pa.float64()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _PACKED.split(", ")])


def _one_a_bucket(spark: SparkSession, buckets: int) -> list[int]:
    """Numbers of blocks of which each falls in a bucket of its own."""
    ids = spark.range(64 * buckets + 256).select(F.col("id").cast("int").alias("id"))
    return [r["id"] for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("b")).agg(F.min("id").alias("id")).orderBy("b").collect()]


def _packed(state: DataFrame, links: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Edges and what blocks send, packed in buckets of their blocks, and the state of a round's start."""
    spark = state.sparkSession
    names = _one_a_bucket(spark, min(blocks, MOST_BUCKETS))
    name = F.col("block") if blocks > len(names) else F.element_at(F.array(*[F.lit(i) for i in names]), F.col("block") + 1)
    state = written(state.withColumn("block", name.cast("int")).withColumn("at", (F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1).cast("int")))
    home = state.select("node", "block", "at")
    ends = links.join(home, "node").select("block", F.col("at").alias("head"), "other", "w")
    ends = ends.join(home.select(F.col("node").alias("other"), F.col("block").alias("where"), F.col("at").alias("tail")), "other").select("block", "head", "where", "tail", "w")

    def pack(key, edges):
        block = key[0].as_py()
        head, where, tail, w = (np.asarray(edges.column(c)) for c in ("head", "where", "tail", "w"))
        order = np.lexsort((tail, where, head))
        head, where, tail, w = head[order], where[order].astype(np.int64), tail[order], w[order]
        out = where != block
        reached, number = np.unique((where[out] << 32) + tail[out], return_inverse=True)
        tail = tail.copy()
        tail[out] = -1 - number
        rows = [(block, _EDGES, i, *(c[i * _ROW_EDGES : (i + 1) * _ROW_EDGES].tobytes() for c in (head, tail, w)), *[None] * 4) for i in range(-(-len(head) // _ROW_EDGES))]
        for other in np.unique(reached >> 32):
            rows.append((int(other), _SENDS, block, (reached[reached >> 32 == other] & 0xFFFFFFFF).astype(np.int32).tobytes(), None, None, *[None] * 4))
        return _packed_rows(rows)

    edges = bucketed(ends.groupBy("block").applyInArrow(pack, _PACKED), "block", len(names))

    def start(key, nodes):
        nodes = nodes.sort_by("at")
        values = np.stack([np.asarray(nodes.column(c)) for c in ("x", "y", "vx", "vy", "gx", "gy")])
        return _packed_rows([(key[0].as_py(), _OWN, 0, np.asarray(nodes.column("node")).tobytes(), values.tobytes(), None, *values[:2].min(1), *values[:2].max(1))])

    state = written(state.groupBy("block").applyInArrow(start, _PACKED))
    return edges, _packed_round(state, edges, lambda block, held: held.result(block)) if blocks > 1 else state


def _packed_round(state: DataFrame, edges: DataFrame, move: Callable[[int, _Packed], pa.Table]) -> DataFrame:
    """``state`` after each block has moved its nodes and sent the places of those that others reach. Edges stay in their buckets."""

    def apply(key, edges, states):
        return move(key[0].as_py(), _Packed(edges, states))

    return written(edges.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(apply, _PACKED))


def _unpacked(state: DataFrame) -> DataFrame:
    """(node, x, y) of a round's state."""

    def read(batches):
        for batch in batches:
            for node, own in zip(batch.column(0), batch.column(1)):
                x, y = np.frombuffer(own.as_buffer(), np.float64).reshape(6, -1)[:2]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(node.as_buffer(), np.int64)), pa.array(x), pa.array(y)], ["node", "x", "y"])

    return state.where(F.col("kind") == _OWN).select("a", "b").mapInArrow(read, "node long, x double, y double")


def _charged(state: DataFrame, grid: Grid) -> np.ndarray:
    """The charges of all nodes, summed by grid node on the executors; the grid bounds what comes back."""
    size = grid.sides[0] * grid.sides[1]

    def charge(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += grid.charges(np.stack([np.asarray(batch.column(i)) for i in (0, 1)], axis=1))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["place", "a"])

    sums = _unpacked(state).select("x", "y").mapInArrow(charge, "place long, a double").groupBy("place").agg(F.sum("a").alias("a")).toArrow()
    out = np.zeros(size)
    out[np.asarray(sums.column("place"))] = np.asarray(sums.column("a"))
    return out


def tsne(rows: DataFrame, key: str, vector: str, perplexity: float = 30.0, metric: str = "cosine", seed: int = 42, steps: int = 500, early: int = 200, exaggeration: float = 12.0, block: int = TSNE_BLOCK) -> DataFrame:
    """(key, x, y): the t-SNE layout of whole vectors in the unit box; the perplexity is at most the number of other nodes."""
    table = written(neighbours.nodes(rows, vector, metric))
    n = table.count()
    if n < 2:
        return _empty(rows, key) if not n else rows.where(neighbours.node_of(vector).isNotNull()).select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    perplexity = min(perplexity, n - 1)
    found = neighbours.graph(table, min(n - 1, int(3 * perplexity)), seed)
    if metric == "cosine":
        found = found.withColumn("d", F.col("d") * F.col("d") / 2)
    links = written(joint(_per_node(found, lambda d: perplexity_weights(d, perplexity)), n))
    rate = max(n / exaggeration / 4, 50.0)
    state, blocks = _placed(table, n, 4e-4, block, seed)
    edges, state = _packed(state, links, blocks)
    rounds = 1 if blocks == 1 else -(-steps // EPOCHS)
    for turn in range(rounds):
        span, field = range(turn * steps // rounds, (turn + 1) * steps // rounds), None
        if blocks > 1:
            r = state.where(F.col("kind") == _OWN).agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
            room = 0.25 * max(r[2] - r[0], r[3] - r[1]) + 1.0
            grid = Grid(np.array(r[:2]) - room, np.array(r[2:]) + room)
            field = Field(grid, _charged(state, grid))
        shared = rows.sparkSession.sparkContext.broadcast(field)

        def move(block: int, held: _Packed, span=span, shared=shared) -> pa.Table:
            return held.result(block, **tsne_steps(held, span, early, exaggeration, rate, shared.value, n))

        old, state = state, _packed_round(state, edges, move)
        shared.destroy()
        dropped(old)
    dropped(edges)
    return _joined(rows, key, vector, _unpacked(state))
