"""Neighbour graphs, UMAP and t-SNE against brute force."""

import numpy as np
import pytest

from lumenbase.operators import layout as L
from lumenbase.operators import neighbours as N


def strands(n=100, groups=6, width=20, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, width)) * 4
    return np.concatenate([c + np.outer(np.linspace(-3, 3, n), rng.standard_normal(width)) * 0.5 + rng.standard_normal((n, width)) * 0.2 for c in centre])


@pytest.fixture(scope="module")
def vectors(spark):
    x = strands()
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3).cache()


def quality(x, y, k=10):
    """Trustworthiness of a layout, and the share of nearest neighbours that are neighbours in it."""
    d, e = (((p[:, None] - p[None]) ** 2).sum(2) for p in (x, y))
    for m in (d, e):
        np.fill_diagonal(m, np.inf)
    rank, near, n = np.argsort(np.argsort(d, 1), 1), np.argsort(e, 1)[:, :k], len(x)
    over = np.maximum(np.take_along_axis(rank, near, 1) - k + 1, 0).sum()
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * over, np.mean([len(set(a) & set(b)) / k for a, b in zip(near, np.argsort(d, 1)[:, :k])])


def places(out):
    return np.array([[r["x"], r["y"]] for r in sorted(out.collect(), key=lambda r: r["id"])])


def exact_edges(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1)[:, :k]


@pytest.mark.parametrize("block, least", [(2048, 1.0), (100, 0.97)])
def test_neighbour_graph(spark, vectors, block, least):
    """One block is exact; several, mended by NN-descent, have nearly all neighbours."""
    x, df = vectors
    table = N.nodes(df, "v")
    number = {r["node"]: r["id"] for r in df.select("id", N.node_of("v").alias("node")).collect()}
    got = {}
    for r in N.graph(table, 8, block=block).collect():
        got.setdefault(number[r["node"]], set()).add(number[r["other"]])
        a, b = x[number[r["node"]]], x[number[r["other"]]]
        assert r["d"] == pytest.approx(np.sqrt(((a - b) ** 2).sum()))
    assert len(got) == len(x) and all(len(s) == 8 for s in got.values())
    found = sum(len(got[i] & set(w)) for i, w in enumerate(exact_edges(x, 8).tolist()))
    assert found >= least * 8 * len(x)


def test_graph_compares_all_pairs(spark):
    """Also of more nodes than a block of NN-descent holds each has all its nearest, and nothing is descended."""
    x = np.random.default_rng(3).standard_normal((9000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(5)
    number = {r["node"]: r["id"] for r in df.select("id", N.node_of("v").alias("node")).collect()}
    got = N.graph(N.nodes(df, "v"), 10).toArrow()
    found = {}
    for a, b, d in zip(*(got.column(c).to_pylist() for c in ("node", "other", "d"))):
        found.setdefault(number[a], {})[number[b]] = d
    assert len(found) == len(x) and all(len(f) == 10 for f in found.values())
    for i in range(0, len(x), 45):
        d = np.sqrt(((x.astype(float) - x[i]) ** 2).sum(1))
        near = np.argsort(d)[1:11]
        assert set(found[i]) == set(near.tolist()) and all(found[i][j] == pytest.approx(d[j]) for j in near)


@pytest.mark.parametrize("x", [np.eye(400), np.random.default_rng(4).standard_normal((400, 8)) + 1e5, np.random.default_rng(5).standard_normal((400, 4)) * 1e25, np.zeros((3, 2)) + np.arange(3)[:, None]])
def test_nearest_do_not_depend_on_order(x):
    """Equal distances, vectors far from zero, beyond the range of floats, fewer others than neighbours asked for."""
    node, rng, k = np.random.default_rng(6).integers(-(1 << 62), 1 << 62, len(x)), np.random.default_rng(7), min(20, len(x) - 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    rows = set()
    for order in (np.arange(len(x)), rng.permutation(len(x))):
        asked = N._Asked(node[:100], x[:100], k)
        for part in np.array_split(order, 3):
            asked.see(node[part], x[part])
        assert np.allclose(asked.d, np.sort(d, 1)[:100, :k], rtol=1e-9)
        rows.add(asked.other.tobytes())
    assert len(rows) == 1


def test_descent_mends_blocks(spark, vectors):
    """What two sets of small blocks part, two rounds of NN-descent find."""
    x, df = vectors
    table, near = N.nodes(df, "v").cache(), exact_edges(x, 8).tolist()
    number = {r["node"]: r["id"] for r in df.select("id", N.node_of("v").alias("node")).collect()}
    hits = lambda edges: sum(number[r["other"]] in near[number[r["node"]]] for r in edges.collect())
    first = N.in_blocks(table, 8, 42, 40, 2).cache()
    before, after = hits(first), hits(N.descend(table, N.descend(table, first, 8, 1).cache(), 8, 2))
    assert before < 0.9 * 8 * len(x) and after > before + 0.5 * (8 * len(x) - before)


def test_descent_compares_fresh_pairs_only(spark, vectors):
    """Edges that have introduced their ends bring nothing more; a round says which of its edges are new, whatever k is."""
    x, df = vectors
    table = N.nodes(df, "v").cache()
    first = N.in_blocks(table, 8, 42, 40, 2).cache()
    rows = lambda edges: sorted((r["node"], r["other"], r["d"]) for r in edges.collect())
    assert rows(N.descend(table, first.selectExpr("*", "false as fresh"), 8, 1)) == rows(first)
    after = N.descend(table, first, 8, 1)
    old = {(a, b) for a, b, _ in rows(first)}
    assert all(r["fresh"] == ((r["node"], r["other"]) not in old) for r in after.collect())
    many = N.in_blocks(table, N.MOST + 10, 42, 100, 2).cache()
    left = {(r["node"], r["other"]) for r in N.descend(table, many, N.MOST + 10, 1).where("fresh").collect()} & {(a, b) for a, b, _ in rows(many)}
    assert left  # not introduced yet: their turn comes


def test_vectors_of_floats_stay_floats(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<float>")
    for metric in ("euclidean", "cosine"):
        assert N.nodes(df, "v", metric).schema["v"].dataType.simpleString() == "array<float>"


def test_curve_and_weights():
    a, b = L.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=2e-3), pytest.approx(0.895, abs=2e-3))
    d = np.sort(np.abs(np.random.default_rng(1).standard_normal((50, 15))), axis=1)
    w = L.smooth_weights(d)
    assert np.allclose(w[:, 0], 1) and np.allclose(w.sum(1), np.log2(16), atol=1e-3) and (np.diff(w, axis=1) <= 0).all()
    p = L.perplexity_weights(d, 5.0)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(-(p * np.log(p)).sum(1)), 5, atol=1e-3)
    assert np.isfinite(L.smooth_weights(np.zeros((2, 3)))).all() and np.allclose(L.perplexity_weights(np.zeros((2, 3)), 30.0), 1 / 3)


def test_symmetric_weights(spark):
    links = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.4), (1, 3, 0.25)], "node long, other long, w double")
    want = {(1, 2): 0.7, (2, 1): 0.7, (1, 3): 0.25, (3, 1): 0.25}
    assert {(r["node"], r["other"]): pytest.approx(r["w"]) for r in L.fuzzy_union(links).collect()} == want
    assert sum(r["w"] for r in L.joint(links, 3).collect()) == pytest.approx(1.15 / 3)


def gradient(p, y):
    gap = y[:, None] - y[None]
    k = 1 / (1 + (gap**2).sum(2))
    np.fill_diagonal(k, 0)
    return 4 * (((p - k / k.sum()) * k)[..., None] * gap).sum(1), k


def block_of(p, y):
    n = len(y)
    b = L._Block.__new__(L._Block)
    b.node, b.own, b.at = np.arange(n), n, y.copy()
    b.head, b.tail = (m.ravel() for m in np.nonzero(p))
    b.w = p[b.head, b.tail]
    b.state = {c: np.full(n, float(c[0] == "g")) for c in ("vx", "vy", "gx", "gy")}
    return b


@pytest.mark.parametrize("scale, near", [(0.01, 5e-3), (1.0, 5e-3), (20.0, 2e-2)])
def test_tsne_gradient(scale, near):
    """Attraction and the grid's repulsion against all pairs, also with part of the positions held as charges."""
    rng = np.random.default_rng(2)
    y, p = rng.standard_normal((300, 2)) * scale, rng.random((300, 300)) * (rng.random((300, 300)) < 0.1)
    p = (p + p.T) / (p + p.T).sum()
    want, k = gradient(p, y)
    grid = L.Grid(y.min(0) - 1e-6, y.max(0) + 1e-6)
    force, z = L.repulsion(grid, y, 0.0, 0)
    got = 4 * (L.attraction(block_of(p, y)) - force / z)
    assert z == pytest.approx(k.sum(), rel=2e-3)
    assert np.abs(got - want).max() <= near * np.abs(want).max()
    part, z = L.repulsion(grid, y[:100], grid.charges(y[100:]), 200)
    assert np.allclose(part, force[:100]) and z == pytest.approx(k.sum(), rel=2e-3)


def test_moving_block(spark):
    """A block that moves among others that stand: forces and Z of all pairs, by FFT on no more of the grid than it needs."""
    rng = np.random.default_rng(8)
    y = rng.standard_normal((400, 2)) * 10
    own = np.flatnonzero((y[:, 0] > 5) & (y[:, 1] > 0))
    grid = L.Grid(y.min(0) - 15, y.max(0) + 15)
    moving = L.Moving(L.Field(grid, grid.charges(y)), y[own])
    for shift in (0.0, 0.7, -20.0):  # the last beyond the part that was cut
        now = y.copy()
        now[own] += shift
        force, z = moving(now[own], len(y))
        gap = now[own][:, None] - now[None]
        k = 1 / (1 + (gap**2).sum(2))
        want = (k[..., None] ** 2 * gap).sum(1)
        assert np.abs(force - want).max() <= 2e-2 * np.abs(want).max()
        assert z == pytest.approx(gradient(np.zeros((len(y), len(y))), now)[1].sum(), rel=2e-3)
        if shift >= 0:
            assert np.prod(moving.part.sides) < 0.5 * np.prod(grid.sides)


def test_packed_rounds(spark):
    """Of a round of t-SNE only states and positions are shuffled, each block has a task of its own, and each edge finds both its ends."""
    links = spark.createDataFrame([(i, (i + d) % 50, i + d / 100) for i in range(50) for d in (1, 2, 7, 49)], "node long, other long, w double")
    state = spark.range(50).selectExpr("id as node", "cast(id % 5 as int) as block", "cast(id as double) as x", "-1D * id as y", "0D as vx", "0D as vy", "1D as gx", "1D as gy")
    edges, state = L._packed(state, links, 5)
    names = sorted(r["block"] for r in state.where("kind = 2").collect())
    assert names == sorted(L._one_a_bucket(spark, 5))
    assert spark.createDataFrame([(n,) for n in names], "b int").selectExpr("pmod(hash(b), 5) as p").distinct().count() == 5
    assert edges.groupBy("block").agg({"block": "count"}).count() == 5

    def seen(block, held):
        assert held.own == 10 and len(held.at) == len(np.unique(held.at, axis=0)) and np.array_equal(held.at[: held.own, 0], held.node)
        head, tail = held.at[held.head, 0].astype(int), held.at[held.tail, 0].astype(int)
        want = sorted((i, (i + d) % 50, i + d / 100) for i in held.node.tolist() for d in (1, 2, 7, 49))
        assert sorted(zip(head.tolist(), tail.tolist(), held.w.tolist())) == want and (held.at[:, 1] == -held.at[:, 0]).all()
        return held.result(block)

    plans = []
    keep, L.written = L.written, lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
    try:
        state = L._packed_round(L._packed_round(state, edges, seen), edges, seen)
    finally:
        L.written = keep
    side = plans[0].split("FlatMapCoGroupsInArrow")[1]
    left = side[side.index("Scan parquet") - 400 : side.index("Scan parquet")]
    assert "Bucketed: true" in side and "Exchange" not in left and "Sort " not in left
    assert sorted((r["node"], r["x"], r["y"]) for r in L._unpacked(state).collect()) == [(i, float(i), -float(i)) for i in range(50)]


def test_tsne_divergence_falls():
    x = strands(50)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = np.argsort(d + np.diag(np.full(len(x), np.inf)), 1)[:, :60]
    p = np.zeros_like(d)
    np.put_along_axis(p, near, L.perplexity_weights(np.take_along_axis(d, near, 1), 20.0), 1)
    p = (p + p.T) / (2 * len(x))
    b, found = block_of(p, np.random.default_rng(1).standard_normal((len(x), 2)) * 1e-4), []
    for step in range(0, 400, 20):
        state = L.tsne_steps(b, range(step, step + 20), 100, 12.0, 50.0, None, len(x))
        b.state |= state
        k = gradient(p, b.at)[1]
        used = p > 0
        found.append((p[used] * np.log(p[used] / (k / k.sum())[used])).sum())
    assert all(b <= a + 1e-3 for a, b in zip(found[8:], found[9:])) and found[-1] < 0.5 * found[0]


def test_rounds_do_not_shuffle_edges(spark):
    """Of a round only positions are shuffled: edges are read from buckets of their blocks, in order, and a node is sent once to a block."""
    links = spark.createDataFrame([(i, (i + d) % 40, 0.5) for i in range(40) for d in (1, 2, 39)], "node long, other long, w double")
    state = spark.range(40).selectExpr("id as node", "cast(id div 10 as int) as block", "cast(id as double) as x", "0D as y", "0D as vx", "0D as vy", "1D as gx", "1D as gy")
    edges, reach = L._prepared(state, links, 4)
    assert edges.count() == 120 and {r["node"]: r["reaches"] for r in reach.collect()} == {10 * b + at: [(b + to) % 4] for b in range(4) for at, to in ((0, -1), (1, -1), (9, 1))}
    plans = []
    def seen(block, held):  # noqa: E306
        assert held.own == 10 and set(held.node[held.head]) == set(range(10 * block, 10 * block + 10)) and (held.at[:, 0] == held.node).all()
        return held.result(block)
    keep, L.written = L.written, lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
    try:
        moved = L._round(state, edges, reach, seen)
    finally:
        L.written = keep
    side = plans[0].split("FlatMapCoGroupsInArrow")[1].split("Union")[0]
    left = side[side.index("Scan parquet") - 400 : side.index("Scan parquet")]
    assert moved.count() == 40 and "Bucketed: true" in side and "Exchange" not in left and "Sort " not in left


@pytest.mark.parametrize("method, block", [(L.umap, 4096), (L.umap, 200), (L.tsne, 4096), (L.tsne, 200)])
def test_layout_keeps_neighbours(vectors, method, block):
    x, df = vectors
    options = {"epochs": 150} if method is L.umap else {"steps": 300, "early": 150, "metric": "euclidean"}
    out = method(df, "id", "v", block=block, **options).cache()
    y = places(out)
    trust, recall = quality(x, y)
    assert trust > 0.99 and recall > 0.7
    assert y.min(0) == pytest.approx([0, 0]) and y.max(0) == pytest.approx([1, 1])
    if block == 4096:  # the partitioning is no matter
        assert np.allclose(places(method(df.repartition(7), "id", "v", **options)), y)


def test_layout_of_few_and_odd_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(10 + i, [2.0, 1.0]) for i in range(30)] + [(50, None), (51, []), (52, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for method in (L.umap, L.tsne):
        got = {r["id"]: (r["x"], r["y"]) for r in method(df, "id", "v", metric="euclidean").collect()}
        assert set(got) == {*range(5), *range(10, 40)} and {got[10 + i] for i in range(30)} == {got[2]} and np.isfinite(list(got.values())).all()
        assert method(df.where("id > 40"), "id", "v").count() == 0 and [tuple(r) for r in method(df.where("id = 3"), "id", "v").collect()] == [(3, 0.0, 0.0)]
