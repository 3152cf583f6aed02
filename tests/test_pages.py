"""Element trees and page records: odd pages, precedence, link strategies."""

from pyspark.sql import functions as F

from lumenbase.operators import pages as P


def test_tree():
    page = P.parsed('<div id="a">x<br>y<p class="one two">z<b>w</b></div>tail<script>if (a < b) "<p>no</p>"</script><p>last')
    div = page.first("div", id="a")
    assert div.text() == "xyzw" and div.lead("br") == "x" and page.text() == "xyzwtaillast"
    assert [e.tag for e in page.walk()] == ["div", "br", "p", "b", "script", "p"]
    p = page.first("p", lambda e: e.has_class("two"))
    assert p.parent is div and p.class_like("^two$") and p.class_like("one two") and not p.has_class("one two")
    deep = P.parsed("<i>" * 20_000 + "x")
    assert deep.text() == "x" and sum(1 for _ in deep.walk()) == 20_000


def test_artwork_precedence():
    wiki = '<div id="info-tab-wikipediadescription"><p>From <i>afar</i><br>no</p></div>'
    own = '<div id="info-tab-description"><p itemprop="description">Own</p></div>'
    assert P.artwork(P.parsed(wiki))["description"] == "From afar" and "wikipedia" not in P.artwork(P.parsed(wiki))
    both = P.artwork(P.parsed(own + wiki))
    assert (both["description"], both["wikipedia"]) == ("Own", "From afar")
    assert P.artwork(P.parsed(own.replace("Own", " ") + wiki))["description"] == "From afar"
    later = P.artwork(P.parsed('<span itemprop="dateCreated">1900</span><li class="dictionary-values"><s>Created:</s><span><a>1901</a></span></li>'))
    assert later["details"] == {"date": "1901"}
    for broken in ('thumbnailSizesModel = {"a"', "", 'thumbnailSizesModel = {"ImageThumbnailsModel": []}', 'thumbnailSizesModel = {"ImageThumbnailsModel": [{"Thumbnails": [{"Url": "u"}]}]}'):
        assert "small" not in P.artwork(P.parsed(f"<main ng-controller='ArtworkViewCtrl' ng-init='{broken}'>"))


def test_link_strategies():
    take = lambda html, depth=9: [(a["path"], a["title"]) for a in P.artwork_links(P.parsed(html), "https://h.org/q", "ann-b", depth)]
    ends = '<a href="/ann-b/one">First</a><a href="https://x/ann-b/two">Second</a>'
    listed = '<div class="my-works"><a href="/ann-b/set/3">Third</a></div><a href="/ann-b/set/4">Fourth</a>'
    assert take(ends + listed) == [("/ann-b/one", "First"), ("https://x/ann-b/two", "Second"), ("/ann-b/set/3", "Third")]
    assert take('<a href="/ann-b/five/">Fifth</a><a href="/q/ann-b/six/">No</a>') == [("/ann-b/five/", "Fifth")]
    skipped = '<a href="/ann-b/all-works">All</a><a href="/ann-b/x">X</a><a href="/ann-b/y">buy now</a><a href="/ann-b/one">First</a><a href="/ann-b/one">Again</a><a href="/ann-b/n">Next</a><a href="/ann-b/m">More</a>'
    assert take(skipped, 2) == [("/ann-b/one", "First"), ("/ann-b/n", "Next")]
    (year,) = P.artwork_links(P.parsed('<li><a href="/ann-b/one">First</a>, 1876</li>'), None, "ann-b", 5)
    assert year["date"] == "1876" and year["url"] == "/ann-b/one"


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<<<>"), (4, "<p>" * 3000), (4, "x" * 100_000)], "page_id long, html string").withColumn("slug", F.lit(None).cast("string")).withColumn("url", F.lit(None).cast("string"))
    works = P.artwork_details(df, "page_id", "html").collect()
    assert sorted(r["page_id"] for r in works) == [1, 2, 3, 4, 4] and all(r["artist"] is None and r["details"] == {} for r in works)
    assert P.artist_details(df, "page_id", "html").where("name is null").count() == 5
    assert P.overview_links(df, "page_id", "url", "slug", "html", 3).count() == 0
    assert P.artwork_details(df.where("false"), "page_id", "html").count() == 0
