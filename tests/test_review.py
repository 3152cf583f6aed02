"""Review operators on small fixtures: validity, staged rows, audits, queues, keyword lists, overview pages."""

from pyspark.sql import functions as F

from lumenbase.operators import canvas, html, keywords, maps, review


def test_entry_errors(spark):
    good = '{"a": {"description": "x"}}'
    rows = spark.createDataFrame(
        [
            ("1", "t", good, '{"small": "http://x/a.jpg"}', "public"),
            ("2", "t", good, '{"small": "u", "huge": "u"}', "public"),
            ("3", "", '["a"]', "{}", "public"),
            ("4", "t", '{"a": "text", "b": {"date": "1900"}}', "[1]", None),
            ("5", "t", "{broken", None, ""),
            ("", None, None, '{"tall": "u"}', "public"),
        ],
        "image_id string, value string, descriptions string, urls string, rights string",
    )
    existing = spark.createDataFrame([("2",), ("2",), ("9",)], "image_id string")
    got = {r[0]: r[1] for r in review.entry_errors(rows, "image_id", "value", ["descriptions", "urls"], existing, "descriptions", "urls", "rights").collect()}
    assert got == {
        "1": [],
        "2": ["id_exists", "size_unknown"],
        "3": ["value_missing", "descriptions_no_object", "urls_missing"],
        "4": ["description_no_object", "description_missing", "urls_no_object", "rights_missing"],
        "5": ["invalid_json_descriptions", "urls_missing", "rights_missing"],
        "": ["id_missing", "value_missing"],
    }


def test_table_rows_take_given_ids_reset_images_and_drop_removed(spark):
    staged = spark.createDataFrame(
        [("a", None, "A", "[1]", False), (None, "b", None, "[2]", None), (None, None, "C", "[3]", False), ("d", None, "D", "[4]", True)],
        "existing_id string, image_id string, value string, images string, removed boolean",
    )
    rows = review.table_rows(staged, "entry_id", ["existing_id", "image_id"], {"value": "", "images": "[]"}, spark.createDataFrame([("a",)], "entry_id string"), F.col("removed"))
    got = sorted((r["value"], r["entry_id"] if r["value"] != "C" else len(r["entry_id"]), r["images"], r["sql_action"]) for r in rows.collect())
    assert got == [("", "b", "[]", "INSERT"), ("A", "a", "[]", "UPDATE"), ("C", 24, "[]", "INSERT")]
    assert sorted(map(tuple, review.export_counts(rows).collect())) == [("INSERT", 2), ("UPDATE", 1)]


def test_audit_leaves_out_rows_without_a_name(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("",), ("b",)], "name string")
    files = spark.createDataFrame([("b",), ("c",)], "name string")
    assert sorted(map(tuple, review.audit(rows, files, "name").collect())) == [("a", "missing"), ("b", "present"), ("c", "unused")]


def test_queue(spark):
    items = spark.createDataFrame([(1, 9), (2, 5), (3, 5), (4, 1)], "id int, at int")
    done = spark.createDataFrame([(4, "merged"), (4, "not_duplicate"), (1, "merged"), (7, "merged")], "id int, outcome string")
    assert tuple(review.queue_counts(items, "id", done).first()) == (4, 2, 1, 2)
    assert tuple(review.next_item(items, "id", "at", done).first()) == (2, 5)
    assert review.next_item(items, "id", "at", items.withColumn("outcome", F.lit("merged"))).count() == 0
    assert tuple(review.queue_counts(items.limit(0), "id", done).first()) == (0, 0, 0, 0)


def test_keyword_lists_filter_after_the_nearest(spark):
    index = spark.createDataFrame([(1, [0.0]), (2, [0.1]), (3, [0.2]), (4, [0.3])], "keyword_id int, embedding array<double>")
    queries = spark.createDataFrame([(7, [0.0])], "query_id int, embedding array<double>")
    allowed = spark.createDataFrame([(2,), (3,), (4,)], "keyword_id int")
    got = keywords.keyword_lists([(index, queries, 2, None), (index, queries, 4, 0.25)], allowed, "query_id", 0.95, True)
    assert [(r["keyword_id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_phrase_matches_look_up_a_phrase_once(spark):
    entries = spark.createDataFrame([(1, [0.0]), (2, [0.5]), (3, [2.0])], "id int, embedding array<double>")
    phrases = spark.createDataFrame([("p", [0.0]), ("p", [0.0]), ("q", [9.0])], "phrase string, embedding array<double>")
    assert sorted(map(tuple, keywords.phrase_matches(phrases, entries, 3, 0.2).collect())) == [("p", 1, 1.0), ("p", 2, 0.5)]


def test_clippings_and_merge_stats(spark):
    rows = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (1, "b", 3), (2, "a", 9)], "user int, content string, at int")
    assert sorted(map(tuple, canvas.distinct_clippings(rows, "user", "content", "at").collect())) == [(1, "a", 1), (1, "b", 3), (2, "a", 9)]
    regions = spark.range(5).withColumnRenamed("id", "region")
    assert tuple(maps.merge_stats(regions, "region", spark.createDataFrame([(0, 3), (1, 2)], "a long, b long")).first()) == (5, 3, 2, 1)


def test_artworks_of_an_overview(spark):
    item = '<li><img src="{src}" {lazy}><div class="title-block"><a class="artwork-name" href="{href}"> T&amp;{n} </a>{year}</div></li>'
    page = (
        "<ul><li><img src='no'></li></ul><ul class='wiki-masonry-container x'>"
        + item.format(src="/lazy-load-placeholder.png", lazy="lazy-load=\"'http://i/1.jpg'\"", href="/en/a/one", n=1, year='<span class="artwork-year"> 1900 </span>')
        + "<li><div class='title-block'><a class='artwork-name' href='/no-image'>x</a></div></li>"
        + "<li><img src='http://i/0.jpg'></li>"
        + item.format(src="http://i/2.jpg", lazy="", href="http://other/two", n=2, year="")
        + "</ul>"
    )
    pages = spark.createDataFrame([(1, "https://www.example.org/en/a", page), (2, None, None), (3, "http://x/", "")], "page_id int, url string, html string")
    got = [tuple(r) for r in html.artworks(pages, "page_id", "url", "html").orderBy("page_id", "pos").collect()]
    assert got == [(1, 0, "T&1", "1900", "http://i/1.jpg", "https://www.example.org/en/a/one"), (1, 1, "T&2", None, "http://i/2.jpg", "http://other/two")]
