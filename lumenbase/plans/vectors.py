"""Vector queries on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import retrieval as R
from .registry import Tables, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)

_D = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _vector(t: Tables, vec_id: int = 0) -> list[float]:
    return t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()[0]


@query(f"SELECT e.vec_id, round({_D}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY {_D}, e.vec_id LIMIT 5")
def knn_topk(t: Tables):
    found = R.knn(t.embeddings.where("vec_id <> 0"), _vector(t), 5, "vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT e.vec_id, e.label, round({_D}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
           ORDER BY {_D}, e.vec_id LIMIT 10""")
def knn_details(t: Tables):
    found = R.knn(t.embeddings, _vector(t), 10, "vec_id")
    return R.with_details(found, t.embeddings.select("vec_id", "label"), "vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"""SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, {_D} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D}, e.vec_id) AS rank
    FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 3""")
def knn_join(t: Tables):
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.knn_join(t.embeddings, queries, 3, "vec_id").select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


_HALF = "SELECT vec_id, list_distance(embedding[{a}:{b}]::DOUBLE[], (SELECT embedding[1:32]::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings ORDER BY d, vec_id LIMIT 8"


@query(f"""SELECT vec_id, round(min(d), 6) AS distance FROM (({_HALF.format(a=1, b=32)}) UNION ALL ({_HALF.format(a=33, b=64)}))
           GROUP BY vec_id ORDER BY min(d), vec_id LIMIT 8""")
def knn_two_index_union(t: Tables):
    e = t.embeddings
    halves = [e.select("vec_id", F.slice("embedding", at, 32).alias("embedding")) for at in (1, 33)]
    return R.knn_of(*halves, _vector(t)[:32], 8, "both", "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT e.vec_id, round(1 - {_D}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE 1 - {_D} >= -0.3")
def similarity_threshold(t: Tables):
    return R.similar_above(t.embeddings, _vector(t), -0.3, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""SELECT a.label, a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
           WHERE {_COS} > 0.3""")
def pairwise_similar_in_group(t: Tables):
    return R.similar_pairs(t.embeddings, "label", "vec_id", "embedding", 0.3).select("label", "a", "b", F.round("similarity", 6).alias("similarity"))


_STAR = "sum(list_transform(embedding, lambda v, i: v::DOUBLE * {}(2 * pi() * (i - 1) / greatest(len(embedding), 4)))) / sqrt(len(embedding) / 2)"
_XY = f"SELECT vec_id, label, list_{_STAR.format('cos')} AS x, list_{_STAR.format('sin')} AS y FROM embeddings"


def points(t: Tables):
    x, y = V.star("embedding")
    return t.embeddings.select("vec_id", "label", x.alias("x"), y.alias("y"))


@query(f"""WITH near AS (SELECT q.vec_id AS query_id, e.vec_id, {_D} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D}, e.vec_id) AS r
              FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
           SELECT query_id, round(sum(x / (1 + d)) / sum(1 / (1 + d)), 6) AS x, round(sum(y / (1 + d)) / sum(1 / (1 + d)), 6) AS y
           FROM near JOIN ({_XY}) USING (vec_id) WHERE r <= 5 GROUP BY query_id""")
def place_new_point(t: Tables):
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = R.knn_join(t.embeddings, queries, 5, "vec_id")
    return R.placed(near, points(t), ["query_id"], "vec_id").select("query_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""SELECT vec_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) * 2 - 1, 6) AS x,
           round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) * 2 - 1, 6) AS y FROM ({_XY})""")
def minmax_unit_box(t: Tables):
    return R.minmax(points(t), ["x", "y"]).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH parts AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
             c AS (SELECT label AS centroid_id, list(m ORDER BY i) AS v FROM parts GROUP BY label),
             d AS (SELECT vec_id, centroid_id, list_distance(embedding::DOUBLE[], v) AS d FROM embeddings, c)
          SELECT vec_id, arg_min(centroid_id, (round(d, 9), centroid_id)) AS centroid_id, round(min(d), 6) AS distance FROM d GROUP BY vec_id""")
def nearest_centroid(t: Tables):
    means = R.mean_vectors(t.embeddings, "label", "embedding").select(F.col("label").alias("centroid_id"), F.col("centroid").alias("embedding"))
    return R.nearest_centroid(t.embeddings, means, "vec_id", "embedding").select("vec_id", "centroid_id", F.round("distance", 6).alias("distance"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
          round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS cosine,
          round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS dot FROM embeddings""")
def vector_scalars(t: Tables):
    one = F.array(*[F.lit(float(x)) for x in _vector(t, 1)])
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.cosine(e, one), 6).alias("cosine"), F.round(V.dot(e, one), 6).alias("dot"))


@query("SELECT vec_id, len(embedding) AS n FROM embeddings")
def vector_bytes_round_trip(t: Tables):
    back = V.from_bytes(V.to_bytes("embedding"))
    return t.embeddings.select("vec_id", F.when(back == F.col("embedding"), F.size(back)).cast("long").alias("n"))


@query("SELECT e.vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id)")
def not_yet_embedded(t: Tables):
    return R.not_yet(t.embeddings.select("vec_id"), t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id")
