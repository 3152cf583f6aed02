"""Map and geometry queries on ``embeddings`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canvas as C
from ..operators import geometry as G
from ..operators import layout as L
from ..operators import maps as M
from ..operators import neighbours as N
from .registry import Tables, registrar
from .vectors import _XY, points

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)

_ZONES = f"""centres AS (SELECT label AS cluster, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM ({_XY}) GROUP BY label),
    zones AS (SELECT cluster, cx, cy, n, CAST(quantile_cont(sqrt((x - cx) ^ 2 + (y - cy) ^ 2), 0.9::DOUBLE) * 1.2 AS DOUBLE) AS radius
              FROM ({_XY}) p JOIN centres c ON p.label = c.cluster GROUP BY cluster, cx, cy, n)"""


def _clustered(t: Tables):
    return points(t).withColumnRenamed("label", "cluster")


@query(f"WITH {_ZONES} SELECT cluster, round(cx, 6) AS cx, round(cy, 6) AS cy, round(radius, 6) AS radius, n FROM zones")
def zones(t: Tables):
    return M.zones(_clustered(t)).select("cluster", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "radius")], "n")


@query(f"""WITH {_ZONES}, l AS (SELECT vec_id, (x - cx) / radius AS lx, (y - cy) / radius AS ly FROM ({_XY}) p JOIN zones z ON p.label = z.cluster)
           SELECT vec_id, round(lx / greatest(1.0::DOUBLE, sqrt(lx * lx + ly * ly)), 6) AS lx, round(ly / greatest(1.0::DOUBLE, sqrt(lx * lx + ly * ly)), 6) AS ly FROM l""")
def zone_local_positions(t: Tables):
    p = _clustered(t)
    return M.local_positions(p, M.zones(p)).select("vec_id", F.round("lx", 6).alias("lx"), F.round("ly", 6).alias("ly"))


@query("""WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
          SELECT count(*) AS regions, avg(n) AS mean_points, max(n) AS most, min(n) AS fewest, list(n ORDER BY n) AS sizes FROM s""")
def region_stats(t: Tables):
    return M.region_stats(t.embeddings, "label")


@query()
def pca_layout(t: Tables):
    return M.pca_layout(t.embeddings, "vec_id", "embedding")


@query()
def umap_layout(t: Tables):
    return L.umap(t.embeddings, "vec_id", "embedding", 15, 0.1, "cosine")


@query()
def tsne_layout(t: Tables):
    return L.tsne(t.embeddings, "vec_id", "embedding")


@query()
def neighbour_graph(t: Tables):
    return N.graph(N.nodes(t.embeddings, "embedding"), 15)


@query()
def kmeans_regions(t: Tables):
    return M.kmeans(points(t).select("vec_id", "x", "y"), 8)[0]


def _cells(t: Tables):
    layout = points(t).groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    scaled = M.minmax(layout, ["x", "y"]).select(F.col("label").cast("int").alias("region"), "x", "y")
    return G.voronoi(scaled)


@query()
def voronoi_cells(t: Tables):
    return _cells(t)


@query()
def region_adjacency(t: Tables):
    return G.adjacency(_cells(t))


@query()
def merge_regions(t: Tables):
    cells = _cells(t)
    return G.merged_regions(cells, G.adjacency(cells))


@query()
def adjacency_stats(t: Tables):
    cells = _cells(t)
    pairs = G.adjacency(cells)
    # one row for each region that was there before merging, two of them in a pair
    regions, merged = G.merged_regions(cells, pairs).agg(F.count("*"), F.count_if("merged")).first()
    return M.adjacency_stats(regions, pairs, merged // 2)


_POLYGONS = [(1, [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]), (2, [(0.0, 0.0), (0.3, 0.05), (0.05, 0.3)]), (3, [(-0.3, 0.0), (0.0, 0.2), (0.3, 0.0), (0.0, 0.05)])]
_EDGES = ", ".join(f"({r}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for r, p in _POLYGONS for a, b in zip(p, p[1:] + p[:1]))


@query(f"""SELECT vec_id, region FROM ({_XY}) p, (VALUES {_EDGES}) e(region, px, py, qx, qy)
           WHERE ((py > y) <> (qy > y)) AND x < (qx - px) * (y - py) / (qy - py) + px GROUP BY vec_id, region HAVING count(*) % 2 = 1""")
def point_in_polygon(t: Tables):
    shapes = t.spark.createDataFrame([(r, [{"x": x, "y": y} for x, y in p]) for r, p in _POLYGONS], "region int, vertices array<struct<x:double,y:double>>")
    return G.inside(points(t).select("vec_id", "x", "y"), shapes).select("vec_id", "region")


_BOX = "SELECT p_partkey, p_brand, (p_partkey * 7919 % 1000)::DOUBLE AS x, (p_partkey * 104729 % 1000)::DOUBLE AS y, p_size::DOUBLE AS w, (p_size + 5)::DOUBLE AS h FROM part"


@query(f"""SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b FROM ({_BOX}) a JOIN ({_BOX}) b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
           AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h""")
def box_overlap_join(t: Tables):
    d = lambda sql: F.expr(sql).cast("double")
    boxes = t.part.select("p_partkey", "p_brand", d("p_partkey * 7919 % 1000").alias("x"), d("p_partkey * 104729 % 1000").alias("y"), d("p_size").alias("w"), d("p_size + 5").alias("h"))
    return C.overlapping(boxes, "p_partkey", "p_brand", 50.0)


_COLOURS = ", ".join(f"'{c}'" for c in G.PALETTE)


@query(f"SELECT label AS pair, [{_COLOURS}][label % {len(G.PALETTE)} + 1] AS colour FROM (SELECT DISTINCT label FROM embeddings)")
def pair_colours(t: Tables):
    return G.pair_colours(t.embeddings.select(F.col("label").alias("pair")).distinct())


@query()
def region_colours(t: Tables):
    return G.analysis(_cells(t))[0]


@query()
def boundary_colours(t: Tables):
    return G.analysis(_cells(t))[1]


@query()
def region_analysis(t: Tables):
    return G.analysis(_cells(t))[2]


@query()
def unbounded_cells(t: Tables):
    """Cells among four far points, a centroid for each label and part."""
    p = points(t).groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return G.voronoi(p.select(F.col("label").cast("int").alias("region"), "x", "y"), far=G.widened_box(points(t))[1])
