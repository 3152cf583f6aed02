"""Planar regions: Voronoi cells, adjacency, pairing, merging, colours, point in polygon.

Cells are computed in blocks of neighbouring centroids, pairs are matched in rounds of joins, outlines are merged pair by pair;
nothing of it passes the driver but block borders and a bounded sample.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written

Point = tuple[float, float]
CELLS = "region int, vertices array<struct<x:double,y:double>>, area double, cx double, cy double"
# Colours of pairs, of regions without one, of boundaries between other regions; how dark a pair's own boundary is.
PALETTE = ["#ff6b6b", "#4ecdc4", "#45b7d1", "#96ceb4", "#feca57", "#ff9ff3", "#54a0ff", "#5f27cd", "#00d2d3", "#ff6348", "#ff7675", "#74b9ff"]
UNPAIRED, OTHER_BOUNDARY, DARK = "#cccccc", "#000000", 0.6
#: Centroids of a block, centroids that stand for all others at first, edges that one task matches.
SITES, SAMPLE, LAST_EDGES = 1024, 4096, 100_000


def clipped(polygon: list[Point], nx: float, ny: float, limit: float) -> list[Point]:
    """The part of a convex polygon where nx * x + ny * y <= limit."""
    out: list[Point] = []
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        a, b = nx * ax + ny * ay - limit, nx * bx + ny * by - limit
        if a <= 0:
            out.append((ax, ay))
        if (a < 0 < b) or (b < 0 < a):
            t = a / (a - b)
            out.append((ax + t * (bx - ax), ay + t * (by - ay)))
    return out


def area_and_centroid(polygon: list[Point]) -> tuple[float, float, float]:
    """Area and centroid of a simple polygon; the vertex mean where the area is zero."""
    twice = sx = sy = 0.0
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        cross = ax * by - bx * ay
        twice, sx, sy = twice + cross, sx + (ax + bx) * cross, sy + (ay + by) * cross
    if abs(twice) < 1e-12:
        n = max(1, len(polygon))
        return 0.0, sum(p[0] for p in polygon) / n, sum(p[1] for p in polygon) / n
    return abs(twice) / 2, sx / (3 * twice), sy / (3 * twice)


def by_angle(polygon: list[Point]) -> list[Point]:
    """Vertices sorted clockwise about their mean."""
    if not polygon:
        return []
    mx, my = sum(p[0] for p in polygon) / len(polygon), sum(p[1] for p in polygon) / len(polygon)
    return sorted(polygon, key=lambda p: -math.atan2(p[1] - my, p[0] - mx))


def widened_box(points: DataFrame, padding: float = 0.2, margin: float = 0.5) -> tuple[tuple[float, float, float, float], list[Point]]:
    """The box of points (x, y) widened by a share of its sides, and four points far beyond its corners."""
    x0, y0, x1, y1 = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    w, h = x1 - x0, y1 - y0
    box = (x0 - padding * w, y0 - padding * h, x1 + padding * w, y1 + padding * h)
    left, low, right, high = box[0] - margin * w, box[1] - margin * h, box[2] + margin * w, box[3] + margin * h
    return box, [(left, low), (right, low), (right, high), (left, high)]


def normalized_box(points: DataFrame, padding: float = 0.025) -> tuple[float, float, float, float]:
    """The square box about (0, 0) whose side is the wider span of the points (x, y) and a little more, at least 2."""
    w, h = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    half = max(max(w or 0.0, h or 0.0) * (1 + padding), 2.0) / 2
    return -half, -half, half, half


def cropped(cells: DataFrame, box: tuple[float, float, float, float] = (-1.0, -1.0, 1.0, 1.0)) -> DataFrame:
    """CELLS cut to a box, with ``clipped``: whether that took anything. A cell that lies outside stays as it is."""
    x0, y0, x1, y1 = box

    def crop(frames):
        for frame in frames:
            rows = []
            for region, vertices in frame[["region", "vertices"]].itertuples(index=False):
                polygon = whole = [(v["x"], v["y"]) for v in vertices]
                for nx, ny, limit in ((-1, 0, -x0), (1, 0, x1), (0, -1, -y0), (0, 1, y1)):
                    polygon = clipped(polygon, nx, ny, limit) if polygon else polygon
                polygon = polygon if len(polygon) >= 3 else whole
                rows.append((region, [{"x": x, "y": y} for x, y in by_angle(polygon)], *area_and_centroid(polygon), polygon != whole))
            yield pd.DataFrame(rows, columns=["region", "vertices", "area", "cx", "cy", "clipped"])

    return cells.select("region", "vertices").mapInPandas(crop, CELLS + ", clipped boolean")


def _cell(x: float, y: float, start: list[Point], others: np.ndarray) -> tuple[list[Point], list[int]]:
    """The part of a convex polygon nearer to (x, y) than to the others, and which of them cut it.

    Others are taken by distance, until the next is twice as far as the farthest corner, so it can cut nothing."""
    d = (others[:, 0] - x) ** 2 + (others[:, 1] - y) ** 2
    polygon, cut = start, []
    for i in np.argsort(d, kind="stable"):
        if not polygon or d[i] > 4 * max((px - x) ** 2 + (py - y) ** 2 for px, py in polygon) * (1 + 1e-12):
            break
        if d[i] == 0:
            continue
        ox, oy = others[i]
        left = clipped(polygon, ox - x, oy - y, (ox * ox + oy * oy - x * x - y * y) / 2)
        if left != polygon:
            polygon = left
            cut.append(int(i))
    return polygon, cut


def _blocks(sites: DataFrame, n: int, size: int) -> DataFrame:
    """Sites with a block: strips of equal numbers by x, cut into equal numbers by y."""
    strips = max(1, math.ceil(math.sqrt(n / size)))
    cells = max(1, math.ceil(n / size / strips))
    shares = lambda parts: [i / parts for i in range(1, parts)] or [0.5]
    place = lambda at, c: F.size(F.filter(at, lambda e: e < F.col(c)))
    by_x = sites.agg(F.percentile_approx("x", shares(strips), 10_000)).first()[0]
    out = sites.withColumn("_strip", place(F.array(*[F.lit(v) for v in by_x]), "x") if strips > 1 else F.lit(0))
    if cells == 1:
        return out.withColumn("block", F.col("_strip")).drop("_strip")
    rows = out.groupBy("_strip").agg(F.percentile_approx("y", shares(cells), 10_000).alias("_at"))
    return out.join(F.broadcast(rows), "_strip").withColumn("block", F.col("_strip") * cells + place(F.col("_at"), "y")).drop("_strip", "_at")


_CUTS = "region int, x double, y double, reach double, ox double, oy double"


def voronoi(centroids: DataFrame, box: tuple[float, float, float, float] = (-1.0, -1.0, 1.0, 1.0), far: list[Point] | None = None, size: int = SITES) -> DataFrame:
    """CELLS of centroids (region, x, y): each is the box cut by the bisectors to the others; with ``far`` points (of ``widened_box``), the
    cells among these and the others instead, which no box cuts. Centroids in one place share their cell.

    Blocks of about ``size`` neighbouring centroids are cut by each other and by a sample of all, which says how far the rest can
    matter; then each block's others that are near enough cut again, block by block. A cell comes from the few that cut it."""
    sites = written(centroids.select(F.col("region").cast("int").alias("region"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    n = sites.count()
    if not n:
        return centroids.sparkSession.createDataFrame([], CELLS)
    x0, y0, x1, y1 = box
    if far:
        side = 1e4 * max(abs(v) for p in far for v in p) + 1.0
        x0, y0, x1, y1 = -side, -side, side, side
    start = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    placed = written(_blocks(sites, n, size))
    sample = sites.orderBy(F.xxhash64("x", "y")).limit(SAMPLE).select("x", "y").collect() if n > size else []
    known = np.array([*far, *sample] if far else sample, np.float64).reshape(-1, 2)

    def cut(rows: pd.DataFrame, others: np.ndarray) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            polygon, by = _cell(r.x, r.y, start, others)
            reach = max((math.hypot(px - r.x, py - r.y) for px, py in polygon), default=0.0)
            out += [(r.region, r.x, r.y, reach, *others[i]) for i in by] or [(r.region, r.x, r.y, reach, None, None)]
        return pd.DataFrame(out, columns=["region", "x", "y", "reach", "ox", "oy"])

    def inside(key, rows):
        return cut(rows, np.concatenate([rows[["x", "y"]].to_numpy(np.float64), known]))

    cuts = placed.groupBy("block").applyInPandas(inside, _CUTS)
    if n > size:
        cuts = written(cuts)
        spans = placed.groupBy("block").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
        home = placed.select("region", F.col("block").alias("_home"))
        # the corner that is farthest lies within reach, so only others within twice that matter: blocks whose span comes so near
        seen = cuts.select("region", "x", "y", "reach").distinct().join(home, "region")
        gap = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
        wanted = seen.join(F.broadcast(spans), (F.col("block") != F.col("_home")) & (F.hypot(gap("x"), gap("y")) <= 2 * F.col("reach")))

        def beyond(key, rows, others):
            return cut(rows, others[["x", "y"]].to_numpy(np.float64)) if len(rows) else cut(rows, np.zeros((0, 2)))

        more = wanted.select("block", "region", "x", "y").groupBy("block").cogroup(placed.select("block", "x", "y").groupBy("block")).applyInPandas(beyond, _CUTS)
        cuts = cuts.union(more)
    lists = cuts.groupBy("region", "x", "y").agg(F.sort_array(F.collect_set(F.struct("ox", "oy"))).alias("by"))

    def cells(frames):
        for frame in frames:
            rows = []
            for region, x, y, by in frame[["region", "x", "y", "by"]].itertuples(index=False):
                others = np.array([(o["ox"], o["oy"]) for o in by if o["ox"] is not None], np.float64).reshape(-1, 2)
                polygon, _ = _cell(x, y, start, others)
                if len(polygon) >= 3:
                    area, cx, cy = area_and_centroid(polygon)
                    rows.append((region, [{"x": px, "y": py} for px, py in by_angle(polygon)], area, cx, cy))
            yield pd.DataFrame(rows, columns=["region", "vertices", "area", "cx", "cy"])

    return lists.mapInPandas(cells, CELLS)


def shared_boundary(a: list[Point], b: list[Point], near: float = 0.01) -> tuple[str, float] | None:
    """(kind, length) of what two polygons share: 'line', 'vertices', 'point', or None if they lie apart."""
    total, close = 0.0, False
    for (ax, ay), (bx, by) in zip(a, a[1:] + a[:1]):
        length = math.hypot(bx - ax, by - ay)
        if length < 1e-12:
            continue
        ux, uy = (bx - ax) / length, (by - ay) / length
        for (cx, cy), (dx, dy) in zip(b, b[1:] + b[:1]):
            oc, od = abs((cx - ax) * uy - (cy - ay) * ux), abs((dx - ax) * uy - (dy - ay) * ux)
            tc, td = (cx - ax) * ux + (cy - ay) * uy, (dx - ax) * ux + (dy - ay) * uy
            if oc < 1e-6 and od < 1e-6:
                total += max(0.0, min(length, max(tc, td)) - max(0.0, min(tc, td)))
            close = close or (oc < near and -near < tc < length + near) or (od < near and -near < td < length + near)
    rounded = {(round(x, 6), round(y, 6)) for x, y in a} & {(round(x, 6), round(y, 6)) for x, y in b}
    if total > 1e-9:
        return "line", max(total, 0.01)
    if len(rounded) >= 2:
        return "vertices", 0.01
    return ("point", 0.01) if close or rounded else None


def adjacency(cells: DataFrame, cell: float = 0.5) -> DataFrame:
    """(a, b, kind, length, score): adjacent regions. Candidates are regions whose bounding boxes share a grid cell."""
    grid = lambda f, c: F.floor((f - 0.01) / cell) if c < 0 else F.floor((f + 0.01) / cell)
    low = lambda n: F.array_min(F.transform("vertices", lambda v: v[n]))
    high = lambda n: F.array_max(F.transform("vertices", lambda v: v[n]))
    boxed = cells.withColumn("gx", F.explode(F.sequence(grid(low("x"), -1), grid(high("x"), 1)))).withColumn("gy", F.explode(F.sequence(grid(low("y"), -1), grid(high("y"), 1))))
    keep = ["region", "vertices", "cx", "cy"]
    a = boxed.select("gx", "gy", *[F.col(c).alias(f"a_{c}") for c in keep])
    b = boxed.select("gx", "gy", *[F.col(c).alias(f"b_{c}") for c in keep])
    pairs = a.join(b, ["gx", "gy"]).where("a_region < b_region").drop("gx", "gy").dropDuplicates(["a_region", "b_region"])

    def test(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                found = shared_boundary([(v["x"], v["y"]) for v in r.a_vertices], [(v["x"], v["y"]) for v in r.b_vertices])
                if found:
                    d = math.hypot(r.a_cx - r.b_cx, r.a_cy - r.b_cy)
                    rows.append((r.a_region, r.b_region, *found, d * (1.05 - 0.1 * min(found[1] / 5, 1))))
            yield pd.DataFrame(rows, columns=["a", "b", "kind", "length", "score"])

    return pairs.mapInPandas(test, "a int, b int, kind string, length double, score double")


def greedy_pairs(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Pairs (a, b, score) by ascending score, then a and b, each region once."""
    used: set[int] = set()
    out = []
    for a, b, score in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a not in used and b not in used:
            used |= {a, b}
            out.append((a, b, score))
    return out


def matched(pairs: DataFrame, last: int = LAST_EDGES) -> DataFrame:
    """(a, b, score) of the pairs that taking them by ascending score, a and b, each region once, gives.

    In each round a pair that is the first of both its regions is taken and what touches it goes; so it would under the order
    itself. When up to ``last`` pairs are left one task takes them in order."""
    kinds = pairs.schema
    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("a", "b", "score"))
    left = written(pairs.select("a", "b", "score").where("a <> b"))
    done = None
    while left.count() > last:
        order = F.struct("score", "a", "b")
        ends = left.select(F.explode(F.array("a", "b")).alias("end"), order.alias("o")).groupBy("end").agg(F.min("o").alias("first"))
        taken = written(ends.groupBy("first").agg(F.count("*").alias("n")).where("n = 2").select("first.a", "first.b", "first.score"))
        done = taken if done is None else done.union(taken)
        gone = taken.select(F.explode(F.array("a", "b")).alias("end"))
        for c in ("a", "b"):
            left = left.join(gone.withColumnRenamed("end", c), c, "left_anti")
        left = written(left.select("a", "b", "score"))

    def rest(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("a", "b", "score")))]
        found = greedy_pairs(rows)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), types)], ["a", "b", "score"])

    types = [f.type for f in left.limit(0).toArrow().schema]
    end = left.coalesce(1).mapInArrow(rest, schema)
    return end if done is None else done.union(end)


def union_outline(a: list[Point], b: list[Point]) -> list[Point]:
    """Outline of two polygons that share boundary: edges cut at each other's vertices, opposite ones cancelled, the
    rest chained; the largest ring if there are several."""
    def key(p: Point) -> Point:
        return (round(p[0], 6), round(p[1], 6))

    def cut(polygon: list[Point], others: list[Point]) -> list[tuple[Point, Point]]:
        ring = polygon if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(polygon, polygon[1:] + polygon[:1])) > 0 else polygon[::-1]
        out = []
        for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]):
            length = math.hypot(qx - px, qy - py)
            if length < 1e-9:
                continue
            on = [(px, py), (qx, qy)]
            for ox, oy in others:
                t = ((ox - px) * (qx - px) + (oy - py) * (qy - py)) / length**2
                if 1e-9 < t < 1 - 1e-9 and abs((ox - px) * (qy - py) - (oy - py) * (qx - px)) / length < 1e-6:
                    on.append((ox, oy))
            on.sort(key=lambda p: (p[0] - px) * (qx - px) + (p[1] - py) * (qy - py))
            out += [(key(u), key(v)) for u, v in zip(on, on[1:]) if key(u) != key(v)]
        return out

    edges = cut(a, b) + cut(b, a)
    have = set(edges)
    follow: dict[Point, list[Point]] = {}
    for u, v in edges:
        if (v, u) not in have:
            follow.setdefault(u, []).append(v)
    rings = []
    while follow:
        start = at = next(iter(follow))
        ring = []
        while at in follow:
            ring.append(at)
            after = follow[at].pop()
            if not follow[at]:
                del follow[at]
            at = after
            if at == start:
                break
        rings.append(ring)
    return max(rings, key=lambda r: area_and_centroid(r)[0], default=[])


def pairing(pairs: DataFrame) -> DataFrame:
    """(pair, a, b): the matched pairs of adjacent regions that share more than a point, numbered from 0 in their order."""
    chosen = matched(pairs.where("kind <> 'point'"))
    return chosen.select((F.row_number().over(Window.orderBy("score", "a", "b")) - 1).alias("pair"), "a", "b")


def merged_regions(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(old_region, region, merged, vertices): regions after matched pairs merge; merged ones are numbered first, then others by their number."""
    chosen = written(pairing(pairs))
    shape = cells.select("region", "vertices")
    both = chosen.join(shape.select(F.col("region").alias("a"), F.col("vertices").alias("va")), "a").join(shape.select(F.col("region").alias("b"), F.col("vertices").alias("vb")), "b")

    def unite(frames):
        for frame in frames:
            shapes = [union_outline(*([(v["x"], v["y"]) for v in side] for side in (r.va, r.vb))) for r in frame.itertuples(index=False)]
            yield pd.DataFrame({"pair": frame["pair"], "a": frame["a"], "b": frame["b"], "vertices": [[{"x": x, "y": y} for x, y in s] for s in shapes]})

    united = both.select("pair", "a", "b", "va", "vb").mapInPandas(unite, "pair int, a int, b int, vertices array<struct<x:double,y:double>>")
    merged = united.select(F.explode(F.array("a", "b")).alias("old_region"), F.col("pair").alias("region"), F.lit(True).alias("merged"), "vertices")
    rest = shape.join(chosen.select(F.explode(F.array("a", "b")).alias("region")), "region", "left_anti")
    order = rest.select("region", (F.row_number().over(Window.orderBy("region")) - 1).alias("_n"))
    numbered = order.join(F.broadcast(chosen.agg(F.count("*").cast("int").alias("_pairs")))).select("region", (F.col("_n") + F.col("_pairs")).alias("new"))
    return merged.union(rest.join(numbered, "region").select("region", "new", F.lit(False), "vertices"))


def inside(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points (id, x, y) with each region (region, vertices) that contains them, by ray casting as an expression.

    Regions are listed in the grid cells that their boxes touch and joined with the points by cell. A cell has the mean
    size of a box, and no less than a hundredth of the largest, so a region has some ten thousand cells at most."""
    xs, ys = (F.transform("vertices", lambda v: v[c]) for c in ("x", "y"))
    ring = F.zip_with("vertices", F.concat(F.slice("vertices", 2, 1 << 30), F.slice("vertices", 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    boxes = regions.select("region", ring.alias("_edges"), *[f(a).alias(n) for n, f, a in (("x0", F.array_min, xs), ("x1", F.array_max, xs), ("y0", F.array_min, ys), ("y1", F.array_max, ys))])
    mean, most = boxes.agg(F.avg(F.greatest(F.expr("x1 - x0"), F.expr("y1 - y0"))), F.max(F.greatest(F.expr("x1 - x0"), F.expr("y1 - y0")))).first()
    cell = max(mean or 0.0, (most or 0.0) / 100) or 1.0
    at = lambda c: F.floor(F.col(c) / cell)
    listed = boxes.withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1")))).drop("x0", "x1", "y0", "y1")
    crossed = F.filter("_edges", lambda e: ((e["p"]["y"] > F.col("y")) != (e["q"]["y"] > F.col("y"))) & (F.col("x") < (e["q"]["x"] - e["p"]["x"]) * (F.col("y") - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))
    return points.withColumn("_cx", at("x")).withColumn("_cy", at("y")).join(listed, ["_cx", "_cy"]).where(F.size(crossed) % 2 == 1).drop("_edges", "_cx", "_cy")


def procrustes_to_grid(points: np.ndarray) -> np.ndarray:
    """Points (a sample of at most a few thousand) rotated and scaled onto a square grid."""
    n = len(points)
    side = math.ceil(math.sqrt(n))
    grid = np.stack(np.meshgrid(np.linspace(-1, 1, side), np.linspace(-1, 1, side)), axis=-1).reshape(-1, 2)[:n]
    a, b = grid - grid.mean(0), points - points.mean(0)
    a, b = a / max(np.linalg.norm(a), 1e-12), b / max(np.linalg.norm(b), 1e-12)
    u, s, vt = np.linalg.svd(a.T @ b)
    return b @ (u @ vt).T * s.sum()


def pair_colours(pairs: DataFrame) -> DataFrame:
    """(pair, colour): the palette in turn, for pairs numbered from 0."""
    return pairs.withColumn("colour", F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.col("pair") % len(PALETTE) + 1).cast("int")))


def region_colours(regions: DataFrame, chosen: DataFrame) -> DataFrame:
    """(region, pair, colour) of regions (region) given the pairing: grey without a pair."""
    coloured = pair_colours(chosen).select(F.explode(F.array("a", "b")).alias("region"), "pair", "colour")
    return regions.select("region").join(coloured, "region", "left").select("region", "pair", F.coalesce("colour", F.lit(UNPAIRED)).alias("colour"))


def boundary_colours(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adjacent regions (a, b, ...) with is_paired and a colour: the pair's own, darker, or black."""
    own = pair_colours(chosen).select("a", "b", X.darkened(F.col("colour"), DARK).alias("_own"))
    return pairs.join(own, ["a", "b"], "left").select(*[pairs[c] for c in pairs.columns], F.col("_own").isNotNull().alias("is_paired"), F.coalesce("_own", F.lit(OTHER_BOUNDARY)).alias("colour"))


def analysis(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The analysis of a map's cells: regions with colours, boundaries with colours, and one row of figures."""
    cells = written(cells)
    pairs = written(adjacency(cells))
    chosen = written(pairing(pairs))
    boundaries = written(boundary_colours(pairs, chosen))
    counts = boundaries.agg(
        F.count("*").alias("boundaries"), F.count_if("is_paired").alias("paired_boundaries"), F.count_if(~F.col("is_paired")).alias("unpaired_boundaries"),
        F.min("length").alias("shortest"), F.max("length").alias("longest"), F.avg("length").alias("mean_length"),
    )
    shortest = boundaries.join(F.broadcast(boundaries.agg(F.min("length").alias("_least")))).agg(F.count_if(F.col("length") == F.col("_least")).alias("at_shortest"))
    regions = cells.agg(F.count("*").alias("regions"))
    figures = counts.join(shortest).join(regions).join(chosen.agg(F.count("*").alias("pairs"))).withColumn("unpaired_regions", F.col("regions") - 2 * F.col("pairs"))
    return region_colours(cells, chosen), boundaries, figures
