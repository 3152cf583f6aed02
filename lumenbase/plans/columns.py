"""Queries of small operators and column functions on real columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as N
from ..functions import text as X
from ..functions import vector as V
from ..operators import canvas as C
from ..operators import html as H
from ..operators import integrity as I
from ..operators import lookup as L
from ..operators import maps as M
from ..operators import repairs as P
from ..operators import retrieval as R
from ..operators import staging as S
from ..operators import upsert as U
from .registry import Tables, registrar
from .vectors import _XY, points

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 3")
def first_operations(t: Tables):
    return S.under_limit(t.events.select("event_id", "user_id"), "user_id", "event_id", 3)


@query("""WITH p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
        WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3), s AS (SELECT label, count(*) AS items FROM embeddings GROUP BY label)
    SELECT label, a, b, items FROM p JOIN s USING (label) ORDER BY items DESC, label, a, b LIMIT 50""")
def review_queue_of_pairs(t: Tables):
    pairs = R.similar_pairs(t.embeddings, "label", "vec_id", "embedding", 0.3).select("label", "a", "b")
    return R.capped_pairs(pairs, t.embeddings.groupBy("label").agg(F.count("*").alias("items")), "label", 50)


@query("SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey")
def pairs_left_together(t: Tables):
    return I.unlisted_pairs(t.lineitem, "l_orderkey", "l_partkey")


@query("SELECT p_name, max(p_partkey) AS p_partkey, arg_max(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name")
def last_of_name(t: Tables):
    return L.last_per_name(t.part.select("p_name", "p_partkey", "p_brand"), "p_name", "p_partkey")


@query("""SELECT page_id, regexp_matches(lower(url), '\\.(jpeg|jpg|gif|png|webp)$') AS image, regexp_matches(lower(regexp_replace(url, 'html$', 'PNG')), '\\.(jpeg|jpg|gif|png|webp)$') AS renamed,
    contains(lower(html), 'not found') AS missing FROM pages""")
def page_kinds(t: Tables):
    renamed = F.regexp_replace("url", "html$", "PNG")
    return t.pages.select("page_id", X.is_image_url(F.col("url")).alias("image"), X.is_image_url(renamed).alias("renamed"), H.not_found(F.col("html")).alias("missing"))


_PARTS = "string_split(p_type, ' ')"


@query(f"""SELECT p_partkey, 'part, ' || p_name || ', None, ' || p_type AS described, substr(array_to_string(list_concat([p_name, p_brand, p_type], {_PARTS}), ', '), 1, 300) AS valued,
    p_name || ' by ' || p_brand || ' type: ' || p_type || ' ' || array_to_string({_PARTS}[:5], ' ') AS caption, array_to_string(string_split(p_name || ',' || p_type || ',a,b,c,d', ',')[:5], ',') AS parts,
    least(p_brand, p_name) || '-' || greatest(p_brand, p_name) AS pair, 'i_' || substr(sha256(p_brand || chr(31) || p_name), 1, 12) AS id, upper(substr(p_type, 1, 1)) || replace(substr(p_type, 2), '_', ' ') AS label FROM part""")
def captions(t: Tables):
    words, details = F.split("p_type", " "), F.create_map(F.lit("type"), F.col("p_type"))
    return t.part.select(
        "p_partkey", X.description_text(F.lit("part"), F.col("p_name"), F.lit(None), F.col("p_type")).alias("described"),
        X.caption_values(F.col("p_name"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")), words).alias("valued"),
        X.caption(F.col("p_name"), F.array("p_brand"), details, words).alias("caption"), X.caption_parts(F.concat_ws(",", "p_name", "p_type", F.lit("a,b,c,d"))).alias("parts"),
        X.pair_key(F.col("p_brand"), F.col("p_name")).alias("pair"), X.new_id("i_", 12, F.col("p_brand"), F.col("p_name")).alias("id"), X.display_key(F.col("p_type")).alias("label"),
    )


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') || [p_type] AS w, p_brand, p_size FROM part)
    SELECT p_partkey, CASE WHEN list_contains(w, p_brand) THEN w ELSE [p_brand] || w END AS first_put, list_transform(w, lambda x: CASE WHEN x = w[1] THEN p_brand ELSE x END) AS replaced,
        (w || ['a', 'b', 'c', 'd', 'e'])[:least(7, greatest(3, p_size % 10))] AS capped, ['synth', 'brand'] AS sources, p_brand || '|' || w[1] AS combined, 'new|' || p_brand AS updated FROM p""")
def list_columns(t: Tables):
    w = F.array_append(F.split("p_name", " "), F.col("p_type"))
    first = F.get(w, F.lit(0))
    pairs = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    both = lambda m: F.concat_ws("|", F.element_at(m, "a"), F.element_at(m, "b"))
    brand = F.col("p_brand")
    return t.part.select(
        "p_partkey", N.first_put(w, brand).alias("first_put"), N.replaced(w, first, brand).alias("replaced"), N.capped(F.concat(w, F.array(*map(F.lit, "abcde"))), F.col("p_size") % 10).alias("capped"),
        F.transform(N.description_list(pairs(brand=brand, synth=first)), lambda e: e["key"]).alias("sources"), both(N.merged(pairs(a=brand), pairs(a=first, b=first))).alias("combined"),
        both(N.updated(pairs(a=first, b=brand), pairs(a=F.lit("new")))).alias("updated"),
    )


@query("""WITH s AS (SELECT p_partkey, list({'area': (p_partkey * (i + 3) % 17 + 1) * 10 + i, 'url': 'u' || i} ORDER BY (p_partkey * (i + 3) % 17 + 1) * 10 + i, i) AS s FROM part, range(4) r(i) WHERE i < p_size % 4 GROUP BY p_partkey)
    SELECT p_partkey, s[1].url AS small, CASE WHEN len(s) > 2 THEN s[2].url END AS medium, CASE WHEN len(s) > 1 THEN s[-1].url END AS large FROM part LEFT JOIN s USING (p_partkey)""")
def thumbnail_sizes(t: Tables):
    sizes = F.expr("transform(filter(sequence(0, 3), i -> i < p_size % 4), i -> named_struct('width', (p_partkey * (i + 3) % 17 + 1) * 10 + i, 'height', 1, 'url', concat('u', i)))")
    return t.part.select("p_partkey", S.thumbnails(sizes).alias("s")).select("p_partkey", "s.*")


_HALF = "sqrt(list_sum(list_transform(embedding[{}], lambda x: x::DOUBLE * x::DOUBLE)))"


@query(f"SELECT vec_id, round(embedding[1]::DOUBLE / {_HALF.format('1:32')}, 6) AS first, round(embedding[64]::DOUBLE / {_HALF.format('33:64')}, 6) AS last, 64 AS n FROM embeddings")
def multimodal_vectors(t: Tables):
    both = V.multimodal(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return t.embeddings.select("vec_id", both.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"), F.size("v").alias("n"))


@query(f"WITH p AS ({_XY}), bad AS (SELECT count(*) FILTER (x IS NULL OR y IS NULL) AS n FROM p) SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM p, bad WHERE n = 0")
def map_coordinates(t: Tables):
    return M.complete_coordinates(points(t)).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH n AS (SELECT conv_id || ':' || turn AS id FROM conversations WHERE role <> 'system'), l AS (SELECT conv_id || ':' || (turn - 1) AS parent, conv_id || ':' || turn AS child FROM conversations)
    SELECT parent, child FROM l WHERE parent IN (SELECT id FROM n) AND child IN (SELECT id FROM n)""")
def thread_edges(t: Tables):
    nodes = t.conversations.where("role <> 'system'").select(F.concat_ws(":", "conv_id", "turn").alias("id"))
    links = t.conversations.select(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("parent"), F.concat_ws(":", "conv_id", "turn").alias("child"))
    return C.parent_edges(links, nodes)


@query("""SELECT p_partkey || '-copy' AS id, CAST(p_size + 10 * (p_partkey % 3 + 1) AS DOUBLE) AS x, round(p_retailprice + 10 * (p_partkey % 3 + 1), 6) AS y, CAST(p_partkey AS VARCHAR) AS source FROM part""")
def pasted_nodes(t: Tables):
    nodes = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 3).alias("n"))
    copies, edges = C.pasted(nodes, "-copy")
    return copies.join(edges.withColumnRenamed("target", "id"), "id").select("id", "x", F.round("y", 6).alias("y"), "source")


@query("""WITH u AS (SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 1 THEN ' ' || url ELSE url END) AS u FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+') THEN u WHEN regexp_matches(u, '^[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+([/?#:]|$)') THEN 'https://' || u END AS url FROM u""")
def mended_urls(t: Tables):
    url = F.expr("case page_id % 3 when 0 then regexp_replace(url, '^[a-z]+://', '') when 1 then ' ' || url else url end")
    out, _ = P.fixed_urls(t.pages.select("page_id", F.create_map(F.lit("small"), url).alias("urls")), "urls")
    return out.select("page_id", F.element_at("urls", "small").alias("url"))


@query("""SELECT p.p_partkey, coalesce(l.l_comment, p_name) AS p_name FROM part p LEFT JOIN (SELECT l_partkey, max(l_returnflag) AS l_comment FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) l ON p_partkey = l_partkey""")
def corrected_rows(t: Tables):
    new = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_returnflag").alias("p_name"))
    return P.corrected(t.part.select("p_partkey", "p_name"), "p_partkey", new, ["p_name"])[0]


@query("SELECT event_type AS outcome, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type UNION ALL SELECT NULL, count(*) FROM events")
def outcome_counts(t: Tables):
    return P.outcomes(t.events.select(F.col("event_type").alias("outcome")), "outcome")


@query("SELECT conv_id, turn AS at, text FROM conversations")
def version_contents(t: Tables):
    """What each canvas's map of versions holds, entry by entry."""
    return C.version_map(t.conversations, "conv_id", "turn", "text").select("conv_id", F.explode("versions").alias("at", "text"))


_LINKS = "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem"


@query(f"""WITH l AS ({_LINKS}), j AS (SELECT l_orderkey, l_partkey, p_partkey, 'o' || (l_orderkey % 7) AS value FROM l LEFT JOIN part ON l_partkey = p_partkey AND p_size > 2)
    SELECT 'o' || l_orderkey AS entry_id, 'p' || l_partkey AS image_id, 'missing_image' AS issue FROM j WHERE p_partkey IS NULL
    UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'missing_artist_name' FROM j WHERE p_partkey IS NOT NULL AND 'o' || (p_partkey % 7) <> value
    UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'missing_related_keyword' FROM j WHERE p_partkey IS NOT NULL AND p_partkey <> l_orderkey""")
def order_part_issues(t: Tables):
    """Links of all orders to all parts: parts that are not listed, that name another owner, that do not point back."""
    links = t.lineitem.select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("p"), "l_partkey")).alias("images"))
    artists = links.select(F.concat(F.lit("o"), "l_orderkey").alias("entry_id"), F.concat(F.lit("o"), (F.col("l_orderkey") % 7).cast("string")).alias("value"), "images")
    images = t.part.where("p_size > 2").select(F.concat(F.lit("p"), "p_partkey").alias("image_id"), F.array(F.concat(F.lit("o"), (F.col("p_partkey") % 7).cast("string"))).alias("artist_names"), F.array(F.concat(F.lit("o"), "p_partkey")).alias("related_ids"))
    return I.link_issues(artists, images)


@query(f"""WITH e AS (SELECT 'k' || p_partkey AS id, p_name || ' ' || p_partkey AS label, p_partkey FROM part WHERE p_size > 5), r AS ({_LINKS}),
    good AS (SELECT l_orderkey, id, label FROM r JOIN e ON l_partkey = p_partkey),
    bad AS (SELECT l_orderkey, list('k' || l_partkey ORDER BY 'k' || l_partkey) AS ids FROM r WHERE l_partkey NOT IN (SELECT p_partkey FROM e) GROUP BY l_orderkey),
    g AS (SELECT l_orderkey, list(id ORDER BY id) AS ids, list(label ORDER BY label) AS labels FROM good GROUP BY l_orderkey)
    SELECT l_orderkey AS entry_id, coalesce(g.ids, []) AS new_ids, coalesce(g.labels, []) AS new_labels, coalesce(b.ids, []) AS invalid_ids, ['none'] AS invalid_labels, true AS issue
    FROM (SELECT DISTINCT l_orderkey FROM r) LEFT JOIN g USING (l_orderkey) LEFT JOIN bad b USING (l_orderkey)""")
def order_keywords(t: Tables):
    """Ids and labels of all orders' parts brought in line: half of the labels are missing, small parts are unknown."""
    entries = t.part.where("p_size > 5").select(F.concat(F.lit("k"), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_partkey").alias("label"))
    links = t.lineitem.select("l_orderkey", "l_partkey").distinct().join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    label = F.when(F.col("l_partkey") % 2 == 0, F.concat_ws(" ", "p_name", "l_partkey"))
    rows = links.join(entries.select(F.col("id").alias("_id")), F.concat(F.lit("k"), "l_partkey") == F.col("_id"), "left").groupBy(F.col("l_orderkey").alias("entry_id")).agg(
        F.collect_list(F.concat(F.lit("k"), "l_partkey")).alias("ids"), F.concat(F.collect_list(F.when(F.col("_id").isNotNull(), label)), F.array(F.lit("none"))).alias("labels"))
    return I.reconciled(rows, entries).select("entry_id", "new_ids", "new_labels", "invalid_ids", "invalid_labels", "issue")


@query("""SELECT c_custkey, coalesce(list(o_orderkey || ':' || o_orderstatus ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL), []) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def nested_orders(t: Tables):
    return C.nested(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_orderkey", "o_orderstatus"], "orders").withColumn(
        "orders", F.transform("orders", lambda o: F.concat_ws(":", o["o_orderkey"], o["o_orderstatus"]))
    )


@query("SELECT conv_id AS grp, string_agg(text, ' ' ORDER BY turn) AS content, avg(turn) AS x, avg(turn * 2) + 210 AS y FROM conversations GROUP BY conv_id")
def merged_threads(t: Tables):
    nodes = t.conversations.select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), F.col("text").alias("content"), F.col("turn").cast("double").alias("x"), (F.col("turn") * 2.0).alias("y"))
    return C.merged_nodes(nodes, "grp")


@query("""WITH l AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_quantity > 40), f AS (SELECT l_partkey, list(l_orderkey ORDER BY l_orderkey) AS refs FROM l WHERE l_orderkey <> l_partkey GROUP BY l_partkey)
    SELECT p_partkey, [p_partkey] || coalesce(refs, []) AS refs FROM part LEFT JOIN f ON p_partkey = l_partkey""")
def parts_with_orders(t: Tables):
    """Orders appended to each part's own list where they are absent."""
    rows = t.part.select("p_partkey", F.array("p_partkey").alias("refs"))
    refs = t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("ref"))
    return U.append_refs(rows, "p_partkey", "refs", refs)


@query("""WITH h AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part))
    SELECT l_partkey, count(*) AS n, list(l_orderkey ORDER BY l_orderkey)[:3] AS first FROM h GROUP BY l_partkey""")
def containing_orders(t: Tables):
    """How many orders hold each part, and the first three."""
    held = I.holder_rows(t.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", t.lineitem, "l_orderkey", "l_partkey")
    return I.holder_counts(held, "l_partkey", "l_orderkey", 3, t.lineitem.count()).select("l_partkey", F.col("n").cast("long").alias("n"), "first")
