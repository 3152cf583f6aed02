"""Queries of review: queues, audits, reference counts, validation, staged rows, keyword lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canvas as C
from ..operators import keywords as K
from ..operators import lookup as L
from ..operators import maps as M
from ..operators import review as V
from .registry import Tables, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


def _outcomes(t: Tables):
    return t.labels.select("doc_id", F.when(F.col("quality") == 1, "not_duplicate").otherwise("merged").alias("outcome"))


@query("""WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id)
    SELECT count(*) AS total, count(q) AS processed, count(*) FILTER (q = 1) AS not_duplicate, count(*) FILTER (q IS NULL) AS remaining FROM documents LEFT JOIN l USING (doc_id)""")
def queue_counts(t: Tables):
    return V.queue_counts(t.documents, "doc_id", _outcomes(t))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars, doc_id LIMIT 1")
def next_in_queue(t: Tables):
    return V.next_item(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", _outcomes(t))


@query("""SELECT coalesce(d.doc_id, l.doc_id)::VARCHAR AS name, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unused' ELSE 'present' END AS status
    FROM (SELECT DISTINCT doc_id FROM documents WHERE source <> '') d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def file_audit(t: Tables):
    rows = t.documents.select(F.when(F.length("source") > 0, F.col("doc_id").cast("string")).alias("name"))
    return V.audit(rows, t.labels.select(F.col("doc_id").cast("string").alias("name")), "name")


@query("""SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers,
    (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers FROM nation""")
def reference_counts(t: Tables):
    named = lambda df, c: df.select(F.col(c).alias("n_nationkey"))
    return V.reference_counts(t.nation, "n_nationkey", n_suppliers=named(t.supplier, "s_nationkey"), n_customers=named(t.customer, "c_nationkey"))


@query("SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE source ILIKE '%S%'")
def linked_like(t: Tables):
    return V.linked_like(t.documents.select("doc_id", "source"), t.labels, "doc_id", "source", "S")


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_name IN (SELECT p_name FROM part WHERE p_brand = 'Brand#5') GROUP BY p_name")
def first_named(t: Tables):
    return V.first_named(t.part, t.part.where("p_brand = 'Brand#5'"), "p_name", "p_partkey", F.col("p_type") == "ECONOMY")


@query("""SELECT event_id, list_filter([CASE WHEN event_id IN (SELECT doc_id FROM labels) THEN 'id_exists' END, CASE WHEN coalesce(event_type, '') = '' THEN 'value_missing' END,
    CASE WHEN coalesce(props, '') <> '' AND NOT json_valid(props) THEN 'invalid_json_props' END,
    CASE WHEN json_valid(props) AND json_type(props) <> 'OBJECT' THEN 'descriptions_no_object' END,
    CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' AND len(list_filter(json_keys(props), lambda k: json_type(props, '$.' || k) <> 'OBJECT')) > 0 THEN 'description_no_object' END],
    lambda e: e IS NOT NULL) AS errors FROM events""")
def entry_errors(t: Tables):
    return V.entry_errors(t.events, "event_id", "event_type", ["props"], t.labels.select(F.col("doc_id").alias("event_id")), "props")


_STAGED = "SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'UPDATE' ELSE 'INSERT' END AS sql_action FROM documents WHERE NOT coalesce(n_chars < 40, false)"


def _staged(t: Tables):
    return V.table_rows(t.documents, "doc_id", ["doc_id"], {"source": "", "lang": ""}, t.labels, F.col("n_chars") < 40)


@query(_STAGED)
def staged_rows(t: Tables):
    return _staged(t)


@query(f"SELECT sql_action, count(*) AS n FROM ({_STAGED}) GROUP BY sql_action")
def export_counts(t: Tables):
    return V.export_counts(_staged(t))


@query("SELECT conv_id, text, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id, text")
def distinct_clippings(t: Tables):
    return C.distinct_clippings(t.conversations.where("role = 'user'"), "conv_id", "text", "turn")


@query("SELECT count(*) AS n, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM documents")
def page_total(t: Tables):
    return L.page_total(t.documents, 25)


@query("""SELECT n_regionkey, substr(md5('[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']'), 1, 8) AS cache_key FROM nation GROUP BY n_regionkey""")
def merge_cache_key(t: Tables):
    names = t.nation.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    return names.select("n_regionkey", M.cache_key(F.col("names")).alias("cache_key"))


@query("""WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5 AND b.n_regionkey = a.n_regionkey WHERE a.n_nationkey % 10 < 5),
    c AS (SELECT (SELECT count(*) FROM nation) AS n, count(*) AS p FROM p) SELECT n AS original, n - p AS merged, p AS pairs, n - 2 * p AS unmerged FROM c""")
def merge_stats(t: Tables):
    other = t.nation.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    pairs = t.nation.where("n_nationkey % 10 < 5").withColumn("b", F.col("n_nationkey") + 5).join(other, ["b", "n_regionkey"]).select(F.col("n_nationkey").alias("a"), "b")
    return M.merge_stats(t.nation.select("n_nationkey"), "n_nationkey", pairs)


_D = "list_distance({0}::DOUBLE[], {1}::DOUBLE[])"
_WHOLE, _HALF = _D.format("q.embedding", "e.embedding"), _D.format("q.embedding[1:32]", "e.embedding[1:32]")


def _near(distance: str, k: int) -> str:
    return f"""SELECT query_id, keyword_id, label, d, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS keyword_id, e.label, {distance} AS d,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance}, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= {k}"""


@query(f"SELECT query_id AS phrase, keyword_id AS id, round(1 - d, 6) AS similarity FROM ({_near(_WHOLE, 3)}) WHERE 1 - d >= -0.3")
def phrase_matches(t: Tables):
    phrases = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("phrase"), "embedding")
    found = K.phrase_matches(phrases, t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 3, -0.3)
    return found.select("phrase", "id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH u AS (SELECT query_id, keyword_id, d, 0 AS part, rank FROM ({_near(_WHOLE, 6)}) WHERE label % 2 = 0
        UNION ALL SELECT query_id, keyword_id, d, 1, rank FROM ({_near(_HALF, 3)}) WHERE d < 1.0 AND label % 2 = 0),
    e AS (SELECT query_id, keyword_id, min(part * 100 + rank) AS place, arg_max(d, part * 100 + rank) AS d FROM u GROUP BY query_id, keyword_id)
    SELECT query_id, keyword_id, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, keyword_id) AS INTEGER) AS rank FROM e WHERE d < 1.4""")
def keyword_lists(t: Tables):
    index = t.embeddings.select(F.col("vec_id").alias("keyword_id"), "embedding")
    half = index.withColumn("embedding", F.slice("embedding", 1, 32))
    asked = lambda rows: rows.where("keyword_id % 50 = 0").withColumnRenamed("keyword_id", "query_id")
    allowed = t.embeddings.where("label % 2 = 0").select(F.col("vec_id").alias("keyword_id"))
    found = K.keyword_lists([(index, asked(index), 6, None), (half, asked(half), 3, 1.0)], allowed, "query_id", 1.4, False)
    return found.select("query_id", "keyword_id", F.round("distance", 6).alias("distance"), "rank")


_TAIL = _D.format("q.embedding[33:64]", "e.embedding[33:64]")
_KEYWORDS = f"""u AS (SELECT query_id, keyword_id, d, 0 AS part, rank FROM ({_near(_WHOLE, 10)}) WHERE label % 2 = 0
        UNION ALL SELECT query_id, keyword_id, d, 1, rank FROM ({_near(_HALF, 3)}) WHERE d < 1.0 AND label % 2 = 0
        UNION ALL SELECT query_id, keyword_id, d, 2, rank FROM ({_near(_TAIL, 2)}) WHERE d < 1.0 AND label % 2 = 0),
    e AS (SELECT query_id, keyword_id, min(part * 100 + rank) AS place, arg_max(d, part * 100 + rank) AS d FROM u GROUP BY query_id, keyword_id),
    stored AS (SELECT q.vec_id AS query_id, e.vec_id AS keyword_id, e.vec_id - q.vec_id AS pos FROM embeddings q JOIN embeddings e ON e.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 2 WHERE q.vec_id % 50 = 0),
    b AS (SELECT query_id, keyword_id, NULL::DOUBLE AS d, pos AS place FROM stored UNION ALL SELECT query_id, keyword_id, d, 1000 + place FROM e ANTI JOIN stored USING (query_id, keyword_id) WHERE d < 1.4),
    lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, keyword_id) AS rank FROM b) WHERE rank <= 7)"""


def _artists(t: Tables):
    """Stored keywords first, then a broad search, one in the values alone and one of synonyms, both near only; the first seven."""
    index = t.embeddings.select(F.col("vec_id").alias("keyword_id"), "embedding")
    part = lambda at: index.withColumn("embedding", F.slice("embedding", at, 32))
    asked = lambda rows: rows.where("keyword_id % 50 = 0").withColumnRenamed("keyword_id", "query_id")
    allowed = t.embeddings.where("label % 2 = 0").select(F.col("vec_id").alias("keyword_id"))
    found = K.keyword_lists([(index, asked(index), 10, None), (part(1), asked(part(1)), 3, 1.0), (part(33), asked(part(33)), 2, 1.0)], allowed, "query_id", 1.4, False)
    ids = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"))
    stored = ids.withColumn("keyword_id", F.col("query_id") + F.col("pos")).join(index.select("keyword_id"), "keyword_id")
    return K.after_stored(stored, found, "query_id", True)


@query(f"WITH {_KEYWORDS} SELECT query_id, keyword_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM lists")
def artist_keywords(t: Tables):
    return _artists(t).select("query_id", "keyword_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH {_KEYWORDS}, works AS (SELECT vec_id AS work_id, vec_id - vec_id % 50 AS query_id, embedding FROM embeddings WHERE vec_id % 50 IN (10, 11)),
    heirs AS (SELECT work_id, keyword_id, rank AS pos FROM works JOIN lists USING (query_id)),
    near AS (SELECT work_id, keyword_id, d, rank FROM (SELECT q.work_id, e.vec_id AS keyword_id, e.label, {_WHOLE} AS d, row_number() OVER (PARTITION BY q.work_id ORDER BY {_WHOLE}, e.vec_id) AS rank FROM works q, embeddings e)
             WHERE rank <= 6 AND label % 2 = 0 AND d < 1.4),
    c AS (SELECT work_id, keyword_id, NULL::DOUBLE AS d, pos AS place FROM heirs UNION ALL SELECT work_id, keyword_id, d, 1000 + rank FROM near ANTI JOIN heirs USING (work_id, keyword_id))
    SELECT work_id, keyword_id, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY work_id ORDER BY place, keyword_id) AS INTEGER) AS rank FROM c""")
def artwork_keywords(t: Tables):
    works = t.embeddings.where("vec_id % 50 in (10, 11)").select(F.col("vec_id").alias("work_id"), (F.col("vec_id") - F.col("vec_id") % 50).alias("query_id"), "embedding")
    index = t.embeddings.select(F.col("vec_id").alias("keyword_id"), "embedding")
    allowed = t.embeddings.where("label % 2 = 0").select(F.col("vec_id").alias("keyword_id"))
    found = K.keyword_lists([(index, works.select("work_id", "embedding"), 6, None)], allowed, "work_id", 1.4, False)
    out = K.after_stored(K.inherited(works, _artists(t), "query_id", "work_id"), found, "work_id", False)
    return out.select("work_id", "keyword_id", F.round("distance", 6).alias("distance"), "rank")
