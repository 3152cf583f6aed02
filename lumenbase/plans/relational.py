"""Lookups, joins, merges, versions and upserts on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canvas as C
from ..operators import integrity as I
from ..operators import lookup as L
from ..operators import staging as S
from ..operators import upsert as U
from .registry import Tables, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 25 OFFSET 25")
def browse_page(t: Tables):
    return L.page(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id", "n_chars", True, 2, 25)


@query("SELECT v.pos, p_partkey, p_name FROM (VALUES (0, 17), (1, 3), (2, 999999), (3, 17), (4, 5)) v(pos, id) JOIN part ON p_partkey = v.id")
def lookup_batch(t: Tables):
    return L.by_ids(t.part, [17, 3, 999999, 17, 5], "p_partkey").select("pos", "p_partkey", "p_name")


@query("SELECT page_id, url, html FROM pages WHERE contains(lower(url), 'utm') OR contains(lower(html), 'utm') OR contains(lower(CAST(page_id AS VARCHAR)), 'utm')")
def row_text_search(t: Tables):
    return L.containing(t.pages.select("page_id", "url", "html"), "UTM")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3)")
def exact_match_ci(t: Tables):
    name = t.nation.where("n_nationkey = 3").first()["n_name"]
    return L.equal_ci(t.nation.select("n_nationkey", "n_name"), "n_name", name.swapcase())


@query("""WITH probes AS (SELECT n_nationkey AS probe, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN lower(n_name) ELSE n_name || ' !' END AS text FROM nation),
    hits AS (SELECT probe, 1 AS tier, n_nationkey FROM probes JOIN nation ON text = n_name UNION ALL
             SELECT probe, 2, n_nationkey FROM probes JOIN nation ON lower(text) = lower(n_name) UNION ALL
             SELECT probe, 3, n_nationkey FROM probes JOIN nation ON regexp_replace(lower(text), '[^a-z0-9]', '', 'g') = regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g'))
    SELECT probe, tier, n_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY tier, n_nationkey) AS r FROM hits) WHERE r = 1""")
def tiered_lookup(t: Tables):
    text = F.expr("case when n_nationkey % 3 = 0 then n_name when n_nationkey % 3 = 1 then lower(n_name) else n_name || ' !' end")
    probes = t.nation.select(F.col("n_nationkey").alias("probe"), text.alias("text"))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    tiers = [(F.col("text"), F.col("n_name")), (F.lower("text"), F.lower("n_name")), (plain("text"), plain("n_name"))]
    return L.tiered(t.nation, probes, "probe", tiers, "n_nationkey")


@query("SELECT count(*) AS n, count(*) FILTER (props IS NOT NULL AND props NOT IN ('', '[]')) AS n_filled FROM events")
def filled_counts(t: Tables):
    return L.counts(t.events, "props")


@query("SELECT p_brand, a.p_partkey AS a, b.p_partkey AS b, lower(a.p_name) AS name_key FROM part a JOIN part b USING (p_brand) WHERE lower(a.p_name) = lower(b.p_name) AND a.p_partkey < b.p_partkey")
def dup_names_self_join(t: Tables):
    return I.name_pairs(t.part, "p_partkey", "p_name", ["p_brand"])


@query("SELECT p_brand, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title_key, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY ALL HAVING count(*) > 1")
def dup_title_groups(t: Tables):
    from ..functions.text import title_key

    return I.groups(t.part.withColumn("title_key", title_key(F.col("p_name"))), "p_partkey", ["p_brand", "title_key"])


@query("""WITH r AS (SELECT p_brand, lower(p_name) AS grp, p_partkey, p_type, p_size,
               row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_size::DOUBLE DESC, p_partkey) AS k FROM part)
    SELECT p_brand || '|' || grp AS grp, min(p_partkey) FILTER (k = 1) AS p_partkey, arg_max(p_type, (length(p_type), -k)) AS p_type, arg_min(p_size, k) AS p_size,
           coalesce(list(p_partkey ORDER BY p_partkey) FILTER (k > 1), []) AS merged_keys FROM r GROUP BY p_brand, grp""")
def merge_duplicates(t: Tables):
    rows = t.part.withColumn("grp", F.concat_ws("|", "p_brand", F.lower("p_name"))).withColumn("score", F.col("p_size").cast("double"))
    return I.merge_groups(rows, "grp", "p_partkey", "score", ["p_type"], ["p_size"])


@query("SELECT doc_id, source, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS found FROM documents d")
def orphan_refs(t: Tables):
    return I.checked_refs(t.documents.select("source", "doc_id"), "doc_id", t.labels, "doc_id")


@query("""SELECT source, count(*) AS n_refs, count(*) FILTER (NOT found) AS n_missing
    FROM (SELECT source, doc_id IN (SELECT doc_id FROM labels) AS found FROM documents) GROUP BY source HAVING count(*) FILTER (NOT found) > 0""")
def orphan_counts(t: Tables):
    return I.orphan_counts(I.checked_refs(t.documents.select("source", "doc_id"), "doc_id", t.labels, "doc_id"), "source")


@query("""WITH r AS (SELECT p_partkey AS old, first_value(p_partkey) OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_size DESC, p_partkey) AS new FROM part)
    SELECT l_orderkey, l_linenumber, coalesce(new, l_partkey) AS l_partkey FROM lineitem LEFT JOIN r ON l_partkey = old""")
def merge_repoints_references(t: Tables):
    parts = t.part.select("p_brand", F.lower("p_name").alias("name_key"), "p_partkey", "p_size")
    moved = I.replacements(parts, ["p_brand", "name_key"], "p_partkey", F.col("p_size"))
    return I.repointed_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", moved)


@query("""WITH a AS (SELECT 'n' || n_nationkey AS entry_id, n_name AS value, n_regionkey, n_nationkey FROM nation),
    l AS (SELECT entry_id, value, n_nationkey, 'i' || (n_nationkey + d) AS image_id FROM a, (VALUES (0), (5)) v(d) WHERE n_nationkey % 7 <> 0),
    i AS (SELECT 'i' || n_nationkey AS image_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'x' END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey ELSE 'y' END AS rel FROM nation),
    j AS (SELECT l.*, i.name, i.rel, i.image_id IS NOT NULL AS found FROM l LEFT JOIN i USING (image_id))
    SELECT entry_id, image_id, 'missing_image' AS issue FROM j WHERE NOT found UNION ALL
    SELECT entry_id, image_id, 'missing_artist_name' FROM j WHERE found AND name <> value UNION ALL
    SELECT entry_id, image_id, 'missing_related_keyword' FROM j WHERE found AND rel <> entry_id UNION ALL
    SELECT entry_id, NULL, 'malformed_json' FROM a WHERE n_nationkey % 7 = 0""")
def integrity_issues(t: Tables):
    k = "n_nationkey"
    artists = t.nation.select(F.expr(f"'n' || {k}").alias("entry_id"), F.col("n_name").alias("value"), F.expr(f"case when {k} % 7 <> 0 then array('i' || {k}, 'i' || ({k} + 5)) end").alias("images"))
    images = t.nation.select(F.expr(f"'i' || {k}").alias("image_id"), F.expr(f"array(case when {k} % 2 = 0 then n_name else 'x' end)").alias("artist_names"), F.expr(f"array(case when {k} % 3 = 0 then 'n' || {k} else 'y' end)").alias("related_ids"))
    return I.link_issues(artists, images)


@query("""WITH e AS (SELECT 'k' || n_nationkey AS id, n_name AS label FROM nation),
    r AS (SELECT 'r' || r_regionkey AS entry_id, list('k' || n_nationkey ORDER BY n_nationkey) || ['kX'] AS ids, list(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0) || ['Nothing'] AS labels
          FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey),
    i AS (SELECT entry_id, unnest(ids) AS ref FROM r), l AS (SELECT entry_id, unnest(labels) AS ref FROM r),
    pairs AS (SELECT entry_id, e.id, e.label FROM i JOIN e ON i.ref = e.id UNION SELECT entry_id, e.id, e.label FROM l JOIN e ON l.ref = e.label)
    SELECT entry_id, list(id ORDER BY id) AS new_ids, list(label ORDER BY label) AS new_labels, ['kX'] AS invalid_ids, ['Nothing'] AS invalid_labels, true AS issue FROM pairs GROUP BY entry_id""")
def keyword_reconcile(t: Tables):
    entries = t.nation.select(F.expr("'k' || n_nationkey").alias("id"), F.col("n_name").alias("label"))
    rows = t.nation.groupBy("n_regionkey").agg(
        F.concat(F.array_sort(F.collect_list(F.expr("'k' || n_nationkey"))), F.array(F.lit("kX"))).alias("ids"),
        F.concat(F.array_sort(F.collect_list(F.expr("case when n_nationkey % 2 = 0 then n_name end"))), F.array(F.lit("Nothing"))).alias("labels"),
    )
    rows = rows.select(F.expr("'r' || n_regionkey").alias("entry_id"), "ids", "labels")
    return I.reconciled(rows, entries).drop("ids", "labels")


@query("SELECT l_partkey, list(DISTINCT l_orderkey ORDER BY l_orderkey) AS found FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_partkey")
def reverse_containment(t: Tables):
    orders = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return I.holders(t.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", orders, "l_orderkey", "parts")


@query("SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def latest_version(t: Tables):
    return C.latest(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn")


@query("""WITH m AS (SELECT user_id, ts, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM m)
    SELECT user_id, min(ts) AS version_at, max(ts) AS saved_at, any_value(event_type) AS event_type FROM r GROUP BY user_id, run""")
def version_compaction(t: Tables):
    return C.compacted(t.events, "user_id", "ts", "event_type")


@query("SELECT coalesce(max(coalesce(try_cast(split_part(c_name, '#', 2) AS INTEGER), 0)), -1) + 1 AS next_id FROM customer")
def next_id(t: Tables):
    return C.next_id(t.customer, "c_name", "#")


@query("SELECT r_regionkey, r_name, list(n_nationkey || ' ' || n_name ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def nest_children(t: Tables):
    children = t.nation.withColumnRenamed("n_regionkey", "r_regionkey")
    nested = C.nested(t.region, children, "r_regionkey", ["n_nationkey", "n_name"], "nations")
    return nested.withColumn("nations", F.transform("nations", lambda n: F.concat_ws(" ", n["n_nationkey"].cast("string"), n["n_name"])))


@query("""SELECT coalesce(n.s_suppkey, o.s_suppkey) AS s_suppkey, coalesce(n.s_name, o.s_name) AS s_name, CASE WHEN n.s_suppkey IS NOT NULL THEN n.s_acctbal ELSE o.s_acctbal END AS s_acctbal
    FROM (SELECT s_suppkey, s_name, s_acctbal FROM supplier) o FULL JOIN
         (SELECT s_suppkey + 50 AS s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS s_name, s_acctbal * 2 AS s_acctbal FROM supplier) n ON o.s_suppkey = n.s_suppkey""")
def upsert(t: Tables):
    old = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    new = t.supplier.select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.expr("case when s_suppkey % 2 = 0 then s_name end").alias("s_name"), (F.col("s_acctbal") * 2).alias("s_acctbal"))
    out = U.upsert(old, new.select("s_suppkey", "s_acctbal"), "s_suppkey")
    return U.upsert(out, new.select("s_suppkey", "s_name"), "s_suppkey", keep_null=True)


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 60, 'new ' || s_name FROM supplier WHERE s_suppkey + 60 NOT IN (SELECT s_suppkey FROM supplier)")
def insert_if_absent(t: Tables):
    new = t.supplier.select((F.col("s_suppkey") + 60).alias("s_suppkey"), F.concat(F.lit("new "), "s_name").alias("s_name"))
    return U.insert_absent(t.supplier.select("s_suppkey", "s_name"), new, "s_suppkey")


@query("SELECT o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (o_orderkey % 3 = 0 AND o_orderstatus = 'F')")
def cascade_delete(t: Tables):
    keys = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey")
    children = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return U.cascade(t.orders, children, keys, "o_orderkey", F.col("o_orderstatus") == "F")[1]


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'INSERT INTO supplier (s_suppkey, s_name) VALUES (''' || s_suppkey || ''', ''' || replace(s_name, '''', '''''') || ''')'
          ELSE 'UPDATE supplier SET s_name = ''' || replace(s_name, '''', '''''') || ''' WHERE s_suppkey = ''' || s_suppkey || '''' END AS statement FROM supplier""")
def statement_preview(t: Tables):
    action = F.expr("case when s_suppkey % 2 = 0 then 'INSERT' else 'UPDATE' end")
    return t.supplier.select("s_suppkey", U.statement("supplier", "s_suppkey", ["s_suppkey", "s_name"], action).alias("statement"))


@query("SELECT s_nationkey AS n_nationkey, list(DISTINCT s_suppkey ORDER BY s_suppkey) AS refs FROM supplier GROUP BY s_nationkey UNION ALL SELECT n_nationkey, [] FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def append_if_absent(t: Tables):
    rows = t.nation.select("n_nationkey", F.array().cast("array<bigint>").alias("refs"))
    return U.append_refs(rows, "n_nationkey", "refs", t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("ref")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(t: Tables):
    return S.status_counts(t.events, "event_type")


@query("SELECT CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'SUCCESS' WHEN event_type = (SELECT max(event_type) FROM events) THEN 'SKIPPED' ELSE 'OTHER' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def progress_summary(t: Tables):
    ends = t.events.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    status = F.when(F.col("event_type") == F.col("a"), "SUCCESS").when(F.col("event_type") == F.col("b"), "SKIPPED").otherwise(F.col("event_type"))
    return S.progress(t.events.join(F.broadcast(ends)).select(status.alias("status")))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 0) AS bad FROM labels")
def staging_summary(t: Tables):
    return t.labels.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 0).alias("bad"))


@query("""WITH p AS (SELECT p_partkey AS staged, p_brand, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE replace(p_name, ' ', '-') END AS t FROM part),
    h AS (SELECT staged, e.p_partkey, CASE WHEN trim(lower(t)) = trim(lower(p_name)) THEN 1 ELSE 3 END AS tier FROM p JOIN part e ON lower(p.p_brand) = lower(e.p_brand)
          AND regexp_replace(lower(t), '[^a-z0-9]', '', 'g') = regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'))
    SELECT staged, p_partkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY staged ORDER BY tier, p_partkey) AS r FROM h) WHERE r = 1""")
def fuzzy_match_tiers(t: Tables):
    changed = F.expr("case p_partkey % 3 when 0 then p_name when 1 then upper(p_name) else replace(p_name, ' ', '-') end")
    staged = t.part.select(F.col("p_partkey").alias("staged"), "p_brand", changed.alias("p_name"))
    return S.matched(staged, "staged", "p_name", "p_brand", t.part, "p_partkey")


@query("""SELECT coalesce(s.k, d.k) AS o_custkey, CASE WHEN d.k IS NULL THEN 'new' WHEN s.k IS NULL THEN 'db' ELSE 'update' END AS status
    FROM (SELECT DISTINCT o_custkey AS k FROM orders) s FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer) d ON s.k = d.k""")
def staged_status(t: Tables):
    return S.compared(t.orders, t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("""WITH e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)
    SELECT DISTINCT a.target AS via, a.source, b.target FROM e a JOIN e b ON a.target = b.source""")
def graph_rewire(t: Tables):
    edges = t.nation.select(F.expr("'r' || n_regionkey").alias("source"), F.expr("'n' || n_nationkey").alias("target")).union(t.supplier.select(F.expr("'n' || s_nationkey"), F.expr("'s' || s_suppkey")))
    return C.bridged(edges, t.nation.select(F.expr("'n' || n_nationkey").alias("node")))


@query("SELECT n_regionkey AS grp, string_agg(n_name, ' ' ORDER BY n_nationkey) AS content, avg(n_nationkey) AS x, avg(n_nationkey * 2) + 210 AS y FROM nation GROUP BY n_regionkey")
def merge_nodes(t: Tables):
    nodes = t.nation.select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("content"), F.col("n_nationkey").cast("double").alias("x"), (F.col("n_nationkey") * 2.0).alias("y"))
    return C.merged_nodes(nodes, "grp")


@query("SELECT user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, 'GET' AS method, '/api/' || event_type AS url, props AS body FROM events")
def log_parse(t: Tables):
    from ..sources.files import api_log

    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] API Call: GET /api/"), "event_type", F.lit(" | Body: "), "props", F.lit(" | Query: {} | Params: "), F.col("user_id").cast("string"))
    return api_log(t.events.select(line.alias("value"))).select(F.col("params").cast("long").alias("user_id"), "at", "method", "url", "body")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM m) SELECT user_id, max(ts) AS saved_at, count(*) AS n FROM r GROUP BY user_id, run""")
def session_autosave(t: Tables):
    from ..streaming.jobs import autosaves

    return autosaves(t.events, "user_id", "ts", "6 hours")


@query("SELECT conv_id, count(*) AS n, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def version_map(t: Tables):
    m = C.version_map(t.conversations, "conv_id", "turn", "text")
    return m.select("conv_id", F.size("versions").cast("long").alias("n"), F.array_sort(F.map_keys("versions")).alias("turns"))
