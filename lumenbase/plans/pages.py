"""Records of artists' and artworks' pages. The test tables hold no such pages, so each row of ``part`` and ``customer`` is written as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pages as P
from ..session import dealt
from .registry import Tables, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)

#: Rows of a task that writes and parses their pages; the tables' rows are narrow, so few bytes make many pages.
PAGES = 4000


def of_pages(rows: DataFrame) -> DataFrame:
    return dealt(rows, rows.count(), PAGES)


#: Pixels of a part's i-th image, of p_size % 4 images.
_WIDTH = "(p_partkey * (i + 3) % 17 + 1) * 10 + i"
_THUMBNAILS = f"""concat('{{"ImageThumbnailsModel": [{{"Thumbnails": [', array_join(transform(filter(sequence(0, 3), i -> i < p_size % 4),
    i -> concat('{{"Url": "https://i.example.com/', p_partkey, '/', i, '.PNG?s=1", "Width": ', {_WIDTH}, ', "Height": 10}}')), ', '), ']}}]}}')"""


@query(f"""WITH images AS (SELECT p_partkey, list('https://i.example.com/' || p_partkey || '/' || i || '.PNG?s=1' ORDER BY {_WIDTH}, i) AS urls
               FROM part, range(4) r(i) WHERE i < p_size % 4 GROUP BY p_partkey)
    SELECT p.p_partkey, p_brand AS artist, CASE WHEN p_size % 7 > 0 THEN 'Public domain' END AS rights, CAST(1500 + p_size AS VARCHAR) AS date, replace(p_type, ' ', ', ') AS style,
           p_name AS medium, CASE WHEN p_size % 2 = 0 THEN 'About ' || p_name WHEN p_size % 3 > 0 THEN 'The ' || p_brand || ' of ' || p_type END AS description,
           CASE WHEN p_size % 2 = 0 AND p_size % 3 > 0 THEN 'The ' || p_brand || ' of ' || p_type END AS wikipedia, CASE WHEN p_size % 3 > 0 THEN 'https://w.example.org/' || p_partkey END AS wikipedia_link,
           urls[1] AS small, CASE WHEN len(urls) > 2 THEN urls[2] END AS medium_image, CASE WHEN len(urls) > 1 THEN urls[-1] END AS large, CASE WHEN len(urls) > 0 THEN '.PNG' END AS extension
    FROM part p LEFT JOIN images USING (p_partkey)""")
def artwork_details(t: Tables):
    page = F.expr(f"""concat('<html><title>', p_name, '</title><main ng-controller="ArtworkViewCtrl" ng-init="a = 1; thumbnailSizesModel = ', replace({_THUMBNAILS}, '"', '&quot;'), '">',
        '<span itemprop="name"><a href="/x"> ', p_brand, '</a></span><script>var s = "<a class=copyright>no</a>"</script>', if(p_size % 7 > 0, '<a class="link copyright">Public <b>domain</b></a>', ''),
        '<span itemprop="dateCreated"> ', 1500 + p_size, '</span><ul><li class="dictionary-values"><s>Style:</s><span><a>', replace(p_type, ' ', '</a>, <a>'), '</a><a>,</a></span>',
        '<li class="dictionary-values-gallery"><s>Media: </s> <span><a>', p_name, '</a></span></li><li class="dictionary-values"><s>Empty:</s><span>none</span></li></ul>',
        if(p_size % 2 = 0, concat('<div id="info-tab-description"><p>no</p><p itemprop="description">About <i>', p_name, '</i> <br> and more</p></div>'), ''),
        if(p_size % 3 > 0, concat('<div id="info-tab-wikipediadescription"><p>The ', p_brand, ' of ', p_type, '<p>second</p></p><a class="wiki-link" href=" https://w.example.org/', p_partkey, ' ">W</a></div>'), ''), '</main>')""")
    out = P.artwork_details(of_pages(t.part).select("p_partkey", page.alias("html")), "p_partkey", "html")
    of = lambda name: F.col("details")[name].alias(name)
    return out.select("p_partkey", "artist", "rights", of("date"), of("style"), of("medium"), "description", "wikipedia", "wikipedia_link", "small", F.col("medium").alias("medium_image"), "large", "extension")


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'Life of ' || c_name END AS description, CASE WHEN c_nationkey % 3 = 0 THEN 'https://w.example.org/' || c_custkey END AS wikipedia_link,
    CAST(1400 + c_nationkey AS VARCHAR) AS birth, CASE WHEN c_nationkey % 5 > 0 THEN c_mktsegment ELSE 'Nation ' || c_nationkey END AS nationality, c_mktsegment || ', Other' AS art_movement FROM customer""")
def artist_details(t: Tables):
    page = F.expr("""concat('<meta itemprop="name" content=" ', c_name, ' ">', if(c_nationkey % 2 = 0, concat('<div id="info-tab-wikipediaArticle"><p> Life <b>of</b> ', c_name, '<br/>born'), ''),
        if(c_nationkey % 3 = 0, concat('</p></div><a class="wiki-link" href="https://w.example.org/', c_custkey, '">W</a>'), ''), '<span itemprop="birthDate">', 1400 + c_nationkey, '</span>',
        '<span itemprop="nationality">Nation ', c_nationkey, '</span>', if(c_nationkey % 5 > 0, concat('<ul><li class="dictionary-values"><s>Nationality:</s> <a>', c_mktsegment, '</a></li></ul>'), ''),
        '<ul><li class="x dictionary-values"><s>Art Movement:</s><span><a>', c_mktsegment, '</a></span> <a>Other</a> <a> </a></ul>')""")
    out = P.artist_details(of_pages(t.customer).select("c_custkey", page.alias("html")), "c_custkey", "html")
    return out.select("c_custkey", "name", "description", "wikipedia_link", *[F.col("data")[c].alias(c) for c in ("birth", "nationality", "art_movement")])


_SLUG = "lower(replace(p_brand, '#', '-'))"


@query(f"""WITH p AS (SELECT p_partkey, p_size, p_name, {_SLUG} AS slug FROM part), l AS (
        SELECT p_partkey, 1 AS i, p_name AS title, NULL AS date, '/' || slug || '/p' || p_partkey AS path FROM p WHERE p_size % 5 > 0 AND length(p_name) BETWEEN 2 AND 60
        UNION ALL SELECT p_partkey, 2, 'Study of 1902', '1902', 'https://a.example.com/' || slug || '/study' FROM p WHERE p_size % 5 > 0
        UNION ALL SELECT p_partkey, 3, 'In a list', CAST(1700 + p_size AS VARCHAR), '/' || slug || '/set/2' FROM p WHERE p_size % 5 > 0
        UNION ALL SELECT p_partkey, 4, 'Alone', NULL, '/' || slug || '/only/' FROM p WHERE p_size % 5 = 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS pos FROM l)
    SELECT p_partkey, CAST(pos AS INTEGER) AS pos, title, date, path, CASE WHEN path LIKE '/%' THEN 'https://a.example.com' || path ELSE path END AS url FROM n WHERE pos < 2""")
def overview_links(t: Tables):
    link = lambda path, title: f"concat('<a href=\"', {path}, '\">', {title}, '</a>')"
    own = lambda rest: f"concat('/', {_SLUG}, '{rest}')"
    many = [
        link(own("/all-works"), "'All works'"), link(f"concat('/', {_SLUG}, '/p', p_partkey)", "p_name"), link(f"concat('/', {_SLUG}, '/p', p_partkey)", "'again'"), link("'/other/x'", "'Other'"),
        link(own("/sold"), "'Buy it now'"), "'</div><div>'", link(f"concat('https://a.example.com/', {_SLUG}, '/study')", "' Study of 1902 '"), link(own("/z"), "'Z'"),
        "'<ul class=\"painting-list-text\"><li>'", link(own("/set/2"), "'In a list'"), "concat(' ', 1700 + p_size, '</li></ul>')",
    ]
    page = F.expr(f"concat('<body><div>', if(p_size % 5 > 0, concat({', '.join(many)}), {link(own('/only/'), chr(39) + 'Alone' + chr(39))}), '</div></body>')")
    pages = of_pages(t.part).select("p_partkey", F.expr(_SLUG).alias("slug"), F.lit("https://a.example.com/x/y").alias("url"), page.alias("html"))
    return P.overview_links(pages, "p_partkey", "url", "slug", "html", 2)
