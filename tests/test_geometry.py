"""Cells, matching, merging and colours against plain programs."""

import math

import numpy as np
import pytest

from lumenbase.operators import geometry as G


def plain_cells(sites, start):
    """Each cell cut by the bisectors to all others."""
    out = {}
    for i, (x, y) in sites.items():
        polygon = start
        for ox, oy in sites.values():
            if (ox, oy) != (x, y):
                polygon = G.clipped(polygon, ox - x, oy - y, (ox * ox + oy * oy - x * x - y * y) / 2)
        out[i] = polygon
    return out


def corners(polygon):
    near = []
    for p in sorted(polygon):
        if not any(math.dist(p, q) < 1e-7 for q in near):
            near.append(p)
    return sorted((round(x, 5) + 0.0, round(y, 5) + 0.0) for x, y in near)


def site_table(spark, sites):
    return spark.createDataFrame([(i, x, y) for i, (x, y) in sites.items()], "region int, x double, y double")


def uneven(n, seed):
    """Half of the sites spread out, half crowded, one place held twice."""
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.uniform(-0.9, 0.9, (n // 2, 2)), rng.normal(0.4, 0.02, (n - n // 2, 2))])
    p[-1] = p[0]
    return {i: tuple(map(float, v)) for i, v in enumerate(p)}


@pytest.mark.parametrize("size, sample", [(1024, 4096), (40, 4096), (40, 30)])
def test_cells_equal_plain_clipping(spark, monkeypatch, size, sample):
    monkeypatch.setattr(G, "SAMPLE", sample)
    sites = uneven(500, 3)
    got = {r["region"]: (corners([(v["x"], v["y"]) for v in r["vertices"]]), r["area"]) for r in G.voronoi(site_table(spark, sites), size=size).collect()}
    want = plain_cells(sites, [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)])
    assert set(got) == set(want)
    for i, polygon in want.items():
        area = G.area_and_centroid(polygon)[0]
        assert got[i][1] == pytest.approx(area, abs=1e-9)
        if area > 1e-6:
            assert len(got[i][0]) == len(corners(polygon)) and np.allclose(got[i][0], corners(polygon), atol=2e-5)
    assert sum(a for i, (_, a) in got.items() if i != len(sites) - 1) == pytest.approx(4.0)


@pytest.mark.parametrize("size", [1024, 30])
def test_cells_among_far_points(spark, size):
    """No box: cells at the rim reach to the bisectors with four far points."""
    sites = uneven(120, 5)
    df = site_table(spark, sites)
    box, far = G.widened_box(df)
    xs, ys = zip(*sites.values())
    w, h = max(xs) - min(xs), max(ys) - min(ys)
    assert box == pytest.approx((min(xs) - 0.2 * w, min(ys) - 0.2 * h, max(xs) + 0.2 * w, max(ys) + 0.2 * h))
    assert far[0] == pytest.approx((box[0] - 0.5 * w, box[1] - 0.5 * h)) and far[2] == pytest.approx((box[2] + 0.5 * w, box[3] + 0.5 * h))
    got = {r["region"]: r["area"] for r in G.voronoi(df, far=far, size=size).collect()}
    want = plain_cells({**sites, **{-1 - i: p for i, p in enumerate(far)}}, [(-1e4, -1e4), (1e4, -1e4), (1e4, 1e4), (-1e4, 1e4)])
    assert got == {i: pytest.approx(G.area_and_centroid(want[i])[0], rel=1e-6, abs=1e-9) for i in sites}
    assert G.voronoi(df.where("false"), far=far).count() == 0 and max(got.values()) < 20


@pytest.mark.parametrize("last", [100_000, 0, 15])
def test_matching_equals_sequential(spark, last):
    """Rounds of dominant pairs give what taking pairs in order gives, ties by the regions' numbers."""
    rng = np.random.default_rng(7)
    for n, m in ((12, 30), (60, 200)):
        rows = {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))): float(rng.integers(0, 12)) for _ in range(m)}
        pairs = [(a, b, s) for (a, b), s in rows.items()]
        got = G.matched(spark.createDataFrame(pairs, "a int, b int, score double").repartition(3), last).collect()
        assert sorted(map(tuple, got)) == sorted(G.greedy_pairs(pairs))
    assert G.matched(spark.createDataFrame([], "a int, b int, score double"), last).count() == 0


def test_merging_and_colours(spark):
    sites = {i: (-0.75 + 0.5 * (i % 4), -0.75 + 0.5 * (i // 4)) for i in range(15)}
    cells = G.voronoi(site_table(spark, sites)).cache()
    pairs = G.adjacency(cells).cache()
    chosen = [tuple(r) for r in G.pairing(pairs).orderBy("pair").collect()]
    scored = [(r["a"], r["b"], r["score"]) for r in pairs.where("kind <> 'point'").collect()]
    assert [(a, b) for _, a, b in chosen] == [(a, b) for a, b, _ in G.greedy_pairs(scored)] and [p for p, _, _ in chosen] == list(range(len(chosen)))
    merged = {r["old_region"]: r for r in G.merged_regions(cells, pairs).collect()}
    area = {r["region"]: r["area"] for r in cells.collect()}
    for p, a, b in chosen:
        assert merged[a]["region"] == merged[b]["region"] == p and merged[a]["merged"]
        outline = [(v["x"], v["y"]) for v in merged[a]["vertices"]]
        assert G.area_and_centroid(outline)[0] == pytest.approx(area[a] + area[b])
    alone = sorted(set(range(15)) - {r for _, a, b in chosen for r in (a, b)})
    assert [merged[r]["region"] for r in alone] == [len(chosen) + i for i in range(len(alone))] and alone
    regions, boundaries, figures = (df.collect() for df in G.analysis(cells))
    colour = {r["region"]: r["colour"] for r in regions}
    assert all(colour[a] == colour[b] == G.PALETTE[p % 12] for p, a, b in chosen) and all(colour[r] == "#cccccc" for r in alone)
    mine = {(a, b): G.PALETTE[p % 12] for p, a, b in chosen}
    for r in boundaries:
        base = mine.get((r["a"], r["b"]))
        want = "#" + "".join(f"{int(int(base[i : i + 2], 16) * 0.6):02x}" for i in (1, 3, 5)) if base else "#000000"
        assert (r["is_paired"], r["colour"]) == (base is not None, want)
    (f,) = figures
    lengths = [r["length"] for r in boundaries]
    assert (f["regions"], f["pairs"], f["unpaired_regions"]) == (15, len(chosen), len(alone))
    assert (f["boundaries"], f["paired_boundaries"], f["unpaired_boundaries"]) == (len(boundaries), len(chosen), len(boundaries) - len(chosen))
    assert (f["shortest"], f["longest"], f["at_shortest"]) == (min(lengths), max(lengths), lengths.count(min(lengths)))


def test_boxes_and_cropping(spark):
    points = spark.createDataFrame([(0.0, -3.0), (1.0, 5.0)], "x double, y double")
    assert G.normalized_box(points) == pytest.approx((-4.1, -4.1, 4.1, 4.1)) and G.normalized_box(points.where("x < 0.5")) == (-1.0, -1.0, 1.0, 1.0)
    shapes = {1: [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)], 2: [(0.0, 0.0), (3.0, 0.0), (3.0, 0.5), (0.0, 0.5)], 3: [(4.0, 4.0), (5.0, 4.0), (5.0, 5.0)]}
    cells = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in shapes.items()], "region int, vertices array<struct<x:double,y:double>>")
    got = {r["region"]: r for r in G.cropped(cells).collect()}
    assert [got[i]["clipped"] for i in (1, 2, 3)] == [False, True, False] and [got[i]["area"] for i in (1, 2, 3)] == pytest.approx([1.0, 0.5, 0.5])
    assert max(v["x"] for v in got[2]["vertices"]) == 1.0 and len(got[3]["vertices"]) == 3
