"""Record queries on real columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import html as H
from ..operators import integrity as I
from ..operators import maps as M
from ..operators import records as R
from ..operators import upsert as U
from .pages import of_pages
from .registry import Tables, registrar
from .vectors import _XY, points

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at, user_id || '-' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS version FROM events")
def version_ids(t: Tables):
    at = R.iso(F.col("ts"))
    return t.events.select("event_id", at.alias("at"), R.version_id(F.col("user_id").cast("string"), at).alias("version"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN string_split(p_name, ' ') WHEN 1 THEN [p_name, p_brand] ELSE [p_type] END AS names, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '0' END AS date,
    CASE WHEN p_size % 2 = 0 THEN ['Made of'] ELSE ['Made of', 'Style'] END AS labels FROM part""")
def names_and_dates(t: Tables):
    text = F.expr("case p_partkey % 3 when 0 then concat('[\"', replace(p_name, ' ', '\", \"'), '\"]') when 1 then concat_ws(', ', p_name, p_brand) else p_type end")
    made = F.expr("if(p_size % 2 = 0, map('date', cast(p_size as string), 'made_of', p_type), map('made_of', p_type))")
    found = F.create_map(F.lit("a"), made, F.lit("b"), F.expr("if(p_size % 2 = 0, map('made_of', p_type, 'description', p_name), map('date', '0', 'style', p_name, 'made_of', p_type))"))
    return t.part.select("p_partkey", R.names_of(text).alias("names"), R.dated(found).alias("date"), F.array_distinct(F.transform(R.shown(found), lambda e: e["label"])).alias("labels"))


@query("SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_type, p_partkey) AS p_type FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 40) GROUP BY p_name")
def first_by_name(t: Tables):
    rows = t.part.select("p_name", "p_partkey", "p_type")
    return R.first_match(rows, t.part.where("p_size > 40"), "p_name", "p_partkey").select("p_name", "p_partkey", "p_type")


@query("""WITH e AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1)
    SELECT p_partkey, (SELECT id FROM e WHERE name = lower(p_name)) AS first_id, p_brand AS second, 2 AS n FROM part""")
def artist_links(t: Tables):
    rows = t.part.select("p_partkey", F.array(F.upper("p_name"), "p_brand").alias("names"))
    out = R.artists_of(rows, "p_partkey", "names", t.part.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("value")))
    at = lambda i: F.get("artists", F.lit(i))
    return out.select("p_partkey", at(0)["entryId"].alias("first_id"), at(1)["name"].alias("second"), F.size("artists").alias("n"))


@query("SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS pos, vec_id FROM embeddings")
def region_members(t: Tables):
    return R.region_members(t.embeddings, "label", "vec_id")


@query("""WITH e AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10)
    SELECT o_orderkey, CASE WHEN count(l_partkey) > 0 THEN list(l_partkey ORDER BY n) END AS shown FROM orders LEFT JOIN e ON o_orderkey = l_orderkey AND n <= 3 WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderkey""")
def orders_with_images(t: Tables):
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda e: e["l_partkey"]).alias("images"))
    details = t.part.where("p_size > 10").select("p_partkey", "p_name")
    out = R.with_images(t.orders.select("o_orderkey").join(lists, "o_orderkey"), "o_orderkey", "images", details, "p_partkey")
    return out.select("o_orderkey", F.transform("image_details", lambda i: i["p_partkey"]).alias("shown"))


@query("""SELECT count(*) AS artists, count(*) FILTER (s % 2 > 0) AS new_artists, count(*) FILTER (s % 2 = 0) AS existing_artists, CAST(sum(n - old) AS BIGINT) AS new_artworks, CAST(sum(old) AS BIGINT) AS artworks_to_update
    FROM (SELECT s_suppkey, s_suppkey AS s, count(c_custkey) AS n, count(*) FILTER (c_custkey % 3 = 0) AS old FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey % 50 GROUP BY s_suppkey)""")
def staged_totals(t: Tables):
    works = t.customer.groupBy((F.col("c_custkey") % 50).alias("s_suppkey")).agg(F.collect_list(F.struct((F.col("c_custkey") % 3 == 0).alias("is_existing"))).alias("artworks"))
    return R.staging_summary(t.supplier.join(works, "s_suppkey", "left").select((F.col("s_suppkey") % 2 == 0).alias("is_existing"), "artworks"))


@query("SELECT (SELECT count(*) FROM customer) AS total, count(DISTINCT o_custkey) AS processed, (SELECT count(*) FROM customer) - count(DISTINCT o_custkey) AS invalid FROM orders JOIN customer ON o_custkey = c_custkey")
def name_totals(t: Tables):
    return R.name_summary(t.customer.select(F.col("c_custkey").alias("name")), t.orders.select(F.col("o_custkey").alias("name")))


@query(r"""SELECT event_id, list_filter([CASE WHEN length(props) > 0 AND NOT json_valid(props) THEN 'invalid_json_props' END, CASE WHEN event_type <> 'view' THEN 'invalid_url_site' END,
    CASE WHEN event_id NOT IN (SELECT doc_id FROM labels) THEN 'file_missing' END], lambda e: e IS NOT NULL) AS errors FROM events""")
def submission_errors(t: Tables):
    rows = t.events.select("event_id", "props", F.expr("if(event_type = 'view', 'https://h.org/x', event_type)").alias("site"), F.col("event_id").cast("string").alias("filename"))
    files = t.labels.select(F.col("doc_id").cast("string").alias("filename"))
    return R.submission_errors(rows, "event_id", ["props"], ["site"], files)


_SCORE = "2 + 3 * (p_size % 2) + 2 * (p_size % 3 // 2) + (p_size % 5 // 4) + CASE WHEN length(p_type) > 0 THEN 3 ELSE 0 END + p_size % 4 + 0.01 * length(p_name)"


@query(f"""SELECT p_brand, lower(p_name) AS name_key, arg_min(p_partkey, (-s, p_partkey)) AS kept, round(max(s), 6) AS score FROM (SELECT *, round({_SCORE}, 6)::DOUBLE AS s FROM part)
    GROUP BY p_brand, lower(p_name) HAVING count(*) > 1""")
def most_complete(t: Tables):
    """The row of each group of duplicates that a merge keeps: the most complete, the first on ties."""
    some = lambda n, m: F.expr(f"if(p_size % {n} >= {m}, map('a', p_type), map())").cast("map<string,string>")
    words = F.expr("slice(array('a', 'b', 'c'), 1, p_size % 4)")
    score = F.round(I.completeness(F.col("p_name"), some(2, 1), some(3, 2), F.expr("if(p_size % 5 = 4, '1900', '')"), F.col("p_type"), words), 6)
    rows = t.part.select("p_brand", F.lower("p_name").alias("name_key"), "p_partkey", score.alias("score"))
    best = rows.groupBy("p_brand", "name_key").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("score")).alias("s"), F.col("p_partkey").alias("kept"))).alias("b")).where("n > 1")
    return best.select("p_brand", "name_key", "b.kept", F.round(-F.col("b.s"), 6).alias("score"))


@query("""SELECT p_partkey, CAST(n AS INTEGER) AS pos, p_name AS title, CASE WHEN p_size % 2 = 0 THEN CAST(1800 + n AS VARCHAR) END AS date, 'https://i.example.com/' || n || '.jpg' AS thumbnail,
    'https://a.example.com/w/' || p_partkey || '/' || n AS href FROM part, range(2) r(n)""")
def overview_grid(t: Tables):
    """Artworks of overview pages: one thumbnail is named in place, one loads late, one item has no link."""
    year = lambda n: f"if(p_size % 2 = 0, '<span class=\"artwork-year\"> {1800 + n} </span>', '')"
    link = lambda n: f"""concat('<a class="artwork-name" href="/w/', p_partkey, '/{n}"> ', p_name, ' </a>')"""
    item = lambda n, img, link: f"""'<li>{img}<div class="title-block">', {link}, {year(n)}, '</div></li>'"""
    late = """<img src="/lazy-load-placeholder.png" lazy-load="https://i.example.com/1.jpg">"""
    items = [item(0, '<img src="https://i.example.com/0.jpg">', link(0)), item(5, '<img src="x.jpg">', "'no link'"), item(1, late, link(1))]
    page = F.expr(f"""concat('<ul class="wiki-masonry-container">', {", ".join(items)}, '</ul>')""")
    return H.artworks(of_pages(t.part).select("p_partkey", F.lit("https://a.example.com/x").alias("url"), page.alias("html")), "p_partkey", "url", "html")


@query(f"""WITH e AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1)
    SELECT p_partkey AS "entryId", round(x, 6) AS x, round(y, 6) AS y, p_name AS value, p_brand AS filename, id AS artist_id, p_name AS artist FROM ({_XY}) JOIN part ON p_partkey = vec_id JOIN e ON e.name = lower(p_name)""")
def map_point_rows(t: Tables):
    entries = t.part.select("p_partkey", F.col("p_name").alias("value"), F.col("p_brand").alias("filename"))
    artists = R.artists_of(entries.select("p_partkey", F.array("value").alias("names")), "p_partkey", "names", t.part.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("value")))
    out = M.map_points(points(t).withColumnRenamed("vec_id", "p_partkey"), entries, "p_partkey", ["value", "filename"], artists)
    artist = F.get("artistData.entries", F.lit(0))
    return out.select("entryId", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "artworkData.value", "artworkData.filename", artist["entryId"].alias("artist_id"), artist["name"].alias("artist"))


@query(f"""WITH c AS (SELECT label, count(*) AS n, avg(x) AS x, avg(y) AS y FROM ({_XY}) GROUP BY label)
    SELECT label AS id, 'Region ' || (label + 1) AS label, round(x + 0.0, 6) AS cx, round(y, 6) AS cy, n AS "pointCount", false AS clipped FROM c""")
def region_rows(t: Tables):
    """Squares about the mean of each label's points, as regions."""
    c = points(t).groupBy(F.col("label").cast("int").alias("region")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    corner = lambda i, j: F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"))
    cells = c.select("region", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("vertices"))
    out = M.region_rows(cells, points(t), "label")
    return out.select("id", "label", F.round("centroid.x", 6).alias("cx"), F.round("centroid.y", 6).alias("cy"), "pointCount", "clipped")


@query("SELECT vec_id, len(embedding) AS n_bytes, len(embedding) AS n_text, len(embedding) AS n_base64 FROM embeddings")
def vector_wire_formats(t: Tables):
    """Each format gives the vector back, component by component."""
    back = lambda c: F.when(c == F.col("embedding"), F.size(c)).cast("long")
    e = t.embeddings
    return e.select("vec_id", back(V.from_bytes(V.to_bytes("embedding"))).alias("n_bytes"), back(V.from_text(V.to_text("embedding"))).alias("n_text"), back(V.from_base64(V.to_base64("embedding"))).alias("n_base64"))


_NEW = "SELECT l_partkey, max(l_quantity) AS q, max(l_returnflag) AS flag FROM (SELECT l_partkey + 1000 AS l_partkey, l_quantity, l_returnflag FROM lineitem) GROUP BY l_partkey"


@query(f"""SELECT p_partkey, 'exists' AS reason FROM part WHERE false UNION ALL
    SELECT l_partkey, CASE WHEN NOT q > 48 THEN 'quantity' WHEN flag <> 'R' THEN 'flag' ELSE 'exists' END FROM ({_NEW}) WHERE NOT q > 48 OR flag <> 'R' OR l_partkey IN (SELECT p_partkey FROM part)""")
def refused_rows(t: Tables):
    new = t.lineitem.groupBy((F.col("l_partkey") + 1000).alias("p_partkey")).agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("flag"))
    return U.guarded_insert(t.part.select("p_partkey", F.lit(0.0).alias("q"), F.lit("").alias("flag")), new, "p_partkey", {"quantity": F.col("q") > 48, "flag": F.col("flag") == "R"})[1]


@query(f"""SELECT p_partkey, 0.0::DOUBLE AS q FROM part UNION ALL SELECT l_partkey, q FROM ({_NEW}) WHERE q > 48 AND flag = 'R' AND l_partkey NOT IN (SELECT p_partkey FROM part)""")
def guarded_insert(t: Tables):
    new = t.lineitem.groupBy((F.col("l_partkey") + 1000).alias("p_partkey")).agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("flag"))
    return U.guarded_insert(t.part.select("p_partkey", F.lit(0.0).alias("q"), F.lit("").alias("flag")), new, "p_partkey", {"quantity": F.col("q") > 48, "flag": F.col("flag") == "R"})[0].select("p_partkey", "q")


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS db_name, CASE WHEN c_nationkey % 2 = 0 THEN coalesce(n, 0) ELSE 0 END AS existing_artworks_count, c_nationkey % 3 AS new_artworks_count
    FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def staged_enrichment(t: Tables):
    work = F.struct(F.lit(False).alias("is_existing"))
    old = F.struct(F.lit(True).alias("is_existing"))
    staged = t.customer.select("c_custkey", F.col("c_custkey").alias("existing_id"), (F.col("c_nationkey") % 2 == 0).alias("is_existing"), F.slice(F.array(work, work, old, old), F.greatest(F.lit(1), 3 - F.col("c_nationkey") % 3), F.lit(4)).alias("artworks"))
    entries = t.customer.select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("value"))
    names = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select(F.col("o_orderkey").alias("image_id"), F.array("c_name", "c_name").alias("artist_names"))
    return R.enriched(staged, entries, names).select("c_custkey", "db_name", "existing_artworks_count", "new_artworks_count")
