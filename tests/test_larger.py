"""What showed only on larger tables: cut entities, equal URLs, equal titles, work that landed in few tasks."""

import pytest

from lumenbase import plans
from lumenbase.operators import canvas as C
from lumenbase.operators import html as H
from lumenbase.operators import integrity as I
from lumenbase.operators import staging as S


def test_references_without_semicolon(spark):
    page = '<title>A &amp; b&amp</title><h1>&lt;i&gt; &#x27;q&#x27; &copy &am</h1><p>x<script>if (a && b) "&amp;"</script></p><a href="/s?a=1&copy=2">&quot;c&quot</a>'
    r = H.fields(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html").first()
    assert (r["title"], r["h1"], r["paragraph"]) == ("A & b&amp", "<i> 'q' &copy &am", 'xif (a && b) "&amp;"')
    links = H.links(spark.createDataFrame([(1, "http://h/x", page)], "id int, url string, html string"), "id", "url", "html")
    assert [(l["href"], l["anchor"]) for l in links.collect()] == [("http://h/s?a=1&copy=2", '"c&quot')]


def test_status_of_equal_urls(spark):
    rows = spark.sql("select id, map('small', 'http://h/x') as urls from values (1), (2), (3) t(id)")
    own = spark.createDataFrame([(1, "http://h/x", 200), (2, "http://h/x", 404), (3, "http://h/x", 200)], "id int, url string, code int")
    assert [tuple(r) for r in I.url_issues(rows, "id", "urls", own).collect()] == [(2, "small", "status_404")]
    # asked for by URL alone, its codes make no row twice
    assert sorted(tuple(r) for r in I.url_issues(rows, "id", "urls", own.drop("id")).collect()) == [(i, "small", "status_404") for i in (1, 2, 3)]


def test_equal_titles_are_not_paired(spark):
    staged = spark.range(3).selectExpr("id as staged", "'Red Sea' as title", "'Ann' as artist")
    existing = spark.createDataFrame([(None, "red sea", "ann"), (7, "Red  Sea", "ANN"), (5, "RED SEA", "Ann"), (6, "red sea", "Bo")], "k int, title string, artist string")
    found = S.matched(staged, "staged", "title", "artist", existing, "k")
    assert sorted(map(tuple, found.collect())) == [(i, 5, 1) for i in range(3)]
    # one existing row a title is joined in each of the three tiers; the last aggregate takes the best tier
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 4


def test_large_groups_are_paired_in_parts(spark, monkeypatch):
    monkeypatch.setattr(I, "PART", 4)
    monkeypatch.setattr(I, "PAIRS", 100)
    rows = spark.range(41).selectExpr("id", "if(id < 30, 'X', concat('y', id % 4)) as name", "if(id = 40, null, 'g') as g")
    name = lambda i: "x" if i < 30 else f"y{i % 4}"
    want = {("g", a, b, name(a)) for a in range(40) for b in range(a + 1, 40) if name(a) == name(b)}
    for groups in (50_000, 1):
        monkeypatch.setattr(I, "GROUPS", groups)
        left, right, pairs = I.paired(rows, ["name", "g"], "id")
        assert left.rdd.getNumPartitions() == right.rdd.getNumPartitions() == 10 and pairs == 926
        assert left.groupBy("name", "g", "_part").count().agg({"count": "max"}).first()[0] < 15
        got = list(map(tuple, I.name_pairs(rows, "id", "name", ["g"]).collect()))
        assert len(got) == len(want) and set(got) == want


def test_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(I, "PART", 4)
    monkeypatch.setattr(I, "PAIRS", 100)
    boxes = [(i, "k" if i % 3 else "l", float(i * 7 % 30), float(i * 11 % 20), 4.0 + i % 9, 3.0) for i in range(60)]
    over = lambda a, b: a[1] == b[1] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]
    got = C.overlapping(spark.createDataFrame(boxes, "id int, kind string, x double, y double, w double, h double"), "id", "kind", 10.0)
    assert got.rdd.getNumPartitions() > 4  # as many as the pairs need, not as few as the bytes do
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and over(a, b))


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "ROWS", 20)
    refs = spark.range(200).selectExpr("id div 4 as o", "id % 7 as p")
    held = I.holder_rows(spark.range(5).selectExpr("id as p"), "p", refs, "o", "p")
    out = I.holder_counts(held, "p", "o", 3, 200)
    assert held.rdd.getNumPartitions() == out.rdd.getNumPartitions() == 10
    orders = {p: sorted({i // 4 for i in range(200) if i % 7 == p}) for p in range(5)}
    assert {r["p"]: (r["n"], r["first"]) for r in out.collect()} == {p: (len(o), o[:3]) for p, o in orders.items()}
    pairs = I.unlisted_pairs(refs, "o", "p")
    assert pairs.rdd.getNumPartitions() > 10
    want = {(a % 7, b % 7) for a in range(200) for b in range(200) if a // 4 == b // 4 and a % 7 < b % 7}
    assert sorted(map(tuple, pairs.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["artwork_details", "artist_details", "overview_links", "overview_grid"])
def test_pages_are_dealt_to_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(plans.pages, "PAGES", 50)
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/{'customer' if name == 'artist_details' else 'part'}.parquet").count()
    assert plans.queries()[name](spark, folder).rdd.getNumPartitions() == -(-rows // 50) > 1
