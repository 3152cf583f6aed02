"""Merges of duplicates as classes, on ``part`` and ``embeddings``; nodes removed from conversations' threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canvas as C
from ..operators import merging as M
from ..operators import retrieval as R
from .registry import Tables, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)

#: Parts are links of a chain if brand, name and either type or tenth of the size agree.
_LINKS = """l AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND lower(a.p_name) = lower(b.p_name) AND (a.p_type = b.p_type OR a.p_size // 10 = b.p_size // 10)),
    reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a), classes AS (SELECT a AS p_partkey, min(b) AS root FROM reach GROUP BY a),
    moved AS (SELECT p_partkey AS old, first_value(p_partkey) OVER (PARTITION BY root ORDER BY p_retailprice DESC, p_partkey) AS new FROM classes JOIN part USING (p_partkey))"""


def _links(t: Tables):
    same = [F.col("p_brand"), F.lower("p_name")]
    return M.linked(t.part, "p_partkey", [*same, "p_type"]).union(M.linked(t.part, "p_partkey", [*same, F.expr("p_size div 10")]))


def _merged(t: Tables):
    rows = t.part.select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice", F.expr("array(p_type, cast(p_size as string))").alias("keywords"))
    orders = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return M.merge_everywhere(rows, "p_partkey", M.classes(_links(t)), "p_retailprice", {}, {"lineitem": (orders, "l_partkey")}, {"vectors": (t.embeddings.select("vec_id"), "vec_id")}, longest=["p_type"], united=["keywords"])


@query(f"WITH RECURSIVE {_LINKS} SELECT p_partkey, root FROM classes WHERE p_partkey IN (SELECT a FROM l WHERE a <> b)")
def duplicate_classes(t: Tables):
    return M.classes(_links(t)).select(F.col("key").alias("p_partkey"), "root")


@query(f"""WITH RECURSIVE {_LINKS}, g AS (SELECT new, list_sort(list_distinct(flatten(list([p_type, CAST(p_size AS VARCHAR)])))) AS keywords, max(length(p_type)) AS longest FROM moved JOIN part ON old = p_partkey GROUP BY new)
    SELECT p_partkey, p_size, length(p_type) AS own_type, longest AS type_length, keywords FROM part JOIN g ON p_partkey = new""")
def merged_classes(t: Tables):
    own = t.part.select("p_partkey", F.length("p_type").cast("long").alias("own_type"))
    out = _merged(t)["rows"].select("p_partkey", "p_size", F.length("p_type").cast("long").alias("type_length"), F.array_sort("keywords").alias("keywords"))
    return out.join(own, "p_partkey").select("p_partkey", "p_size", "own_type", "type_length", "keywords")


@query(f"""WITH RECURSIVE {_LINKS} SELECT l_orderkey, l_linenumber, coalesce(new, l_partkey) AS l_partkey FROM lineitem LEFT JOIN moved ON l_partkey = old""")
def class_references(t: Tables):
    return _merged(t)["lineitem"]


@query(f"""WITH RECURSIVE {_LINKS} SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT old FROM moved WHERE old <> new)""")
def class_vectors(t: Tables):
    return _merged(t)["vectors"]


@query("""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.97),
    reach(a, b) AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
    SELECT a AS vec_id, least(a, min(b)) AS root FROM reach GROUP BY a""")
def image_classes(t: Tables):
    pairs = R.similar_pairs(t.embeddings, "label", "vec_id", "embedding", 0.97)
    return M.classes(pairs.select("a", "b")).select(F.col("key").alias("vec_id"), "root")


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, role <> 'user' AS gone FROM conversations),
    e AS (SELECT a.id AS source, a.gone AS gone_a, b.id AS target, b.gone AS gone_b FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    walk(source, here, gone) AS (SELECT source, target, gone_b FROM e WHERE NOT gone_a UNION SELECT walk.source, e.target, e.gone_b FROM walk JOIN e ON walk.gone AND walk.here = e.source)
    SELECT source, here AS target FROM walk WHERE NOT gone""")
def nodes_removed(t: Tables):
    rows = t.conversations.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("id"), "role")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("id").alias("target"))
    edges = rows.join(after, ["conv_id", "turn"]).select(F.col("id").alias("source"), "target")
    return C.without_nodes(edges, rows.where("role <> 'user'").select(F.col("id").alias("node")))
