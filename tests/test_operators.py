"""Operators on small rows with results worked out by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbase import schema
from lumenbase.functions import nested as N
from lumenbase.functions import text as X
from lumenbase.functions import vector as V
from lumenbase.operators import canvas as C
from lumenbase.operators import embed as E
from lumenbase.operators import geometry as G
from lumenbase.operators import html as H
from lumenbase.operators import integrity as I
from lumenbase.operators import keywords as K
from lumenbase.operators import lookup as L
from lumenbase.operators import maps as M
from lumenbase.operators import retrieval as R
from lumenbase.operators import staging as S
from lumenbase.operators import upsert as U


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, text, want",
    [
        (X.slug, "Łódź  O'Neil", "lodz-oneil"),
        (X.slug, "  Þór — ß ", "thor-ss"),
        (X.title_key, "Łódź", "odz"),
        (X.title_key, "Blue  Júg!", "blue jug"),
        (X.url_slug, "A & B/C: d.e", "a-b-c-d-e"),
        (X.label, "Created: ", "date"),
        (X.label, "Some-Label x", "some_label_x"),
        (X.darkened, "#ff8000", "#994c00"),
        (X.display_key, "some_key", "Some key"),
        (X.extension, "http://h/a/b.PNG?x=1", ".png"),
        (X.extension, "http://h/a", ".jpg"),
        (S.artist_name, "artist: Ada", "Ada"),
        (S.artist_name, "12345", None),
        (S.artist_name, "After Ada", None),
        (X.year, "painted in 1889 or 1890", "1889"),
    ],
)
def test_text(spark, make, text, want):
    assert one(spark, make(F.col("t")), t=text) == want


def test_lists_and_captions(spark):
    names = lambda *n: F.array(*[F.lit(x) for x in n]) if n else F.array().cast("array<string>")
    assert [one(spark, X.listed(names(*n))) for n in ([], ["A"], ["A", "B"], ["A", "B", "C"])] == ["", "A", "A and B", "A, B, and C"]
    details = F.create_map(F.lit("date"), F.lit("1900"))
    assert one(spark, X.caption(F.lit("T"), names("A", "B", "C", "D"), details, names("k"))) == "T by A, B, C date: 1900 k"
    assert one(spark, X.caption_values(F.lit("T"), details, names("k", "l"))) == "T, 1900, k, l"
    assert one(spark, X.synonyms(F.lit("Battle Painting"))) == ["Conflict", "War"]


def test_json(spark):
    rows = spark.createDataFrame([("['i2']", True), ("not json", False), ("[1", True), ("plain", True), ("{'a': 1}", True), ('["a"]', True), ("", True), (None, True), ("3+4j", False)], "t string, a boolean")
    got = [tuple(r) for r in rows.select(N.json_issue(F.col("t"), F.col("a")).alias("i")).select("i.kind", "i.converted").collect()]
    assert got == [("python_list", '["i2"]'), ("truly_malformed", None), ("truly_malformed", None), ("bare_string", '["plain"]'), ("python_dict", '{"a": 1}'), (None, None), (None, None), (None, None), ("unknown_python_object", None)]
    assert one(spark, N.cleaned(F.lit("{'a'"))) == "{}" and one(spark, N.cleaned(F.lit('{"a": 1}'))) == '{"a":1}'
    entries = spark.createDataFrame([("a1", '["i1"]'), ("a2", "['i1']")], "entry_id string, images string")
    assert [r["images"] for r in schema.silver(entries).orderBy("entry_id").collect()] == [["i1"], None]


def test_maps(spark):
    a, b = F.expr("map('x', 1, 'y', 2)"), F.expr("map('y', 3, 'z', 4)")
    assert one(spark, N.merged(a, b)) == {"x": 1, "y": 2, "z": 4}
    assert one(spark, N.updated(a, b)) == {"x": 1, "y": 3, "z": 4}
    assert one(spark, N.preferred(F.expr("map('tall', 't')"), "map")) is None
    assert one(spark, N.preferred(F.expr("map('tall', 't')"), "browse")) == "t"


def vectors(spark):
    d = spark.createDataFrame([("p", [0.0, 0.0]), ("q", [1.0, 0.0]), ("r", [0.0, 2.0])], schema.VECTORS)
    v = spark.createDataFrame([("p", [3.0, 4.0]), ("q", [0.0, 1.0]), ("r", [6.0, 8.0])], schema.VECTORS)
    return d, v


def test_two_indexes(spark):
    d, v = vectors(spark)
    run = lambda where: [(r["id"], r["distance"]) for r in R.knn_of(d, v, [0.0, 0.0], 2, where).collect()]
    assert run("description") == [("p", 0.0), ("q", 1.0)] and run("value") == [("q", 1.0), ("p", 5.0)] and run("both") == [("p", 0.0), ("q", 1.0)]
    with pytest.raises(ValueError):
        R.knn_of(d, v, [0.0, 0.0], 2, "x")


def test_placement_and_scaling(spark):
    near = spark.createDataFrame([("n", "a", 0.0), ("n", "b", 1.0)], "new string, id string, distance double")
    where = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 0.0)], "id string, x double, y double")
    assert [tuple(r) for r in R.placed(near, where, ["new"]).collect()] == [("n", 1.0, 0.0)]
    xs = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "x double")
    assert sorted(round(r["x"], 6) for r in R.minmax(xs, ["x"]).collect()) == [-1.0, -0.333333, 1.0]
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_keywords(spark):
    texts = spark.createDataFrame([(1, "Red still life jug"), (2, "")], "id int, text string")
    grams = K.ngrams(texts, "id", "text")
    assert grams.count() == 9
    score = {"still": ("k9", 0.5), "life": ("k8", 0.4), "still life": ("k2", 0.8), "jug": ("k7", 0.3), "red": ("gone", 0.9)}
    matches = spark.createDataFrame([(p, i, s) for p, (i, s) in score.items()], "phrase string, id string, similarity double")
    entries = spark.createDataFrame([("k9",), ("k8",), ("k2",), ("k7",)], "id string")
    named = grams.withColumnRenamed("id", "text_id")
    spans = K.best_spans(K.candidates(named, matches, entries, 0.3), "text_id")
    assert sorted((r["start"], r["stop"], r["id"]) for r in spans.collect()) == [(1, 1, "k9"), (2, 2, "k8"), (3, 3, "k7")]
    tie = matches.withColumn("similarity", F.when(F.col("id") == "k2", 0.9).otherwise(F.col("similarity")))
    spans = K.best_spans(K.candidates(named, tie, entries, 0.3), "text_id")
    assert sorted((r["start"], r["stop"], r["id"]) for r in spans.collect()) == [(1, 2, "k2"), (3, 3, "k7")]
    out = K.annotated(texts.withColumnRenamed("id", "text_id"), "text_id", "text", spans)
    assert sorted((r["pos"], r["words"], r["id"]) for r in out.collect()) == [(0, "Red", None), (1, "still life", "k2"), (3, "jug", "k7")]


def test_merged_keywords(spark):
    part = lambda rows: spark.createDataFrame(rows, "item int, keyword_id string, distance double, rank int")
    got = K.merged_keywords([part([(1, "a", 0.9, 1), (1, "b", 0.5, 2)]), part([(1, "a", 0.1, 1), (1, "c", 0.2, 2)])], "item", 0.7, True)
    assert [r["keyword_id"] for r in got.orderBy("rank").collect()] == ["a", "b", "c"]


def test_zone_of_two_points(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (0, 2.0, 0.0)], "cluster int, x double, y double")
    z = M.zones(p)
    assert [tuple(round(v, 6) for v in r) for r in z.collect()] == [(0, 1.0, 0.0, 1.2, 2)]
    assert sorted(round(r["lx"], 4) for r in M.local_positions(p, z).collect()) == [-0.8333, 0.8333]


def squares(spark):
    made = []
    for i, (x, y) in enumerate([(-1, -1), (0, -1), (-1, 0), (0, 0)]):
        shape = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
        made.append((i, [{"x": float(a), "y": float(b)} for a, b in shape], 1.0, x + 0.5, y + 0.5))
    return spark.createDataFrame(made, G.CELLS)


def test_adjacency_and_merge(spark):
    cells = squares(spark)
    pairs = {(r["a"], r["b"]): r for r in G.adjacency(cells).collect()}
    lines = {k for k, r in pairs.items() if r["kind"] == "line"}
    assert lines == {(0, 1), (0, 2), (1, 3), (2, 3)} and all(pairs[k]["length"] == pytest.approx(1) for k in lines)
    assert {k for k, r in pairs.items() if r["kind"] == "point"} == {(0, 3), (1, 2)}
    assert pairs[(0, 1)]["score"] == pytest.approx(1.03) and pairs[(0, 3)]["score"] == pytest.approx(1.4846, abs=1e-4)
    merged = G.merged_regions(cells, G.adjacency(cells)).collect()
    assert {(r["old_region"], r["region"]) for r in merged} == {(0, 0), (1, 0), (2, 1), (3, 1)}
    assert all(G.area_and_centroid([(v["x"], v["y"]) for v in r["vertices"]])[0] == pytest.approx(2) for r in merged)


def test_voronoi_partitions_the_box(spark):
    rng = np.random.default_rng(3)
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1, 1, (12, 2)))], "region int, x double, y double")
    cells = G.voronoi(sites).cache()
    assert cells.agg(F.sum("area")).first()[0] == pytest.approx(4)
    own = G.inside(sites.withColumnRenamed("region", "id"), cells)
    assert own.count() == 12 and own.where("id <> region").count() == 0


def test_integrity(spark):
    artists = spark.createDataFrame([("a1", "Ada Stone", ["i1", "i9"]), ("a2", "ada stone", []), ("a3", "Bo Reed", None), ("a4", "Cy Lund", [])], "entry_id string, value string, images array<string>")
    images = spark.createDataFrame([("i1", ["Ada Stone"], ["a1", "k1"]), ("i3", ["Ada Stone"], ["a4"])], "image_id string, artist_names array<string>, related_ids array<string>")
    got = {tuple(r) for r in I.link_issues(artists, images).collect()}
    assert got == {("a1", "i9", "missing_image"), ("a3", None, "malformed_json")}
    found, gone = I.recovered(artists.where("images is not null"), images)
    assert [tuple(r) for r in found.collect()] == [("a4", ["i3"])] and [r[0] for r in gone.collect()] == ["a2"]
    rows = spark.createDataFrame([("a1", ["k1"], ["Cubism"]), ("a2", ["kX"], ["Still Life"]), ("a4", [], ["Nothing"])], "entry_id string, ids array<string>, labels array<string>")
    entries = spark.createDataFrame([("k1", "Cubism"), ("k2", "Still Life")], "id string, label string")
    fixed = {r["entry_id"]: r for r in I.reconciled(rows, entries).collect()}
    assert not fixed["a1"]["issue"]
    assert (fixed["a2"]["new_ids"], fixed["a2"]["new_labels"], fixed["a2"]["invalid_ids"]) == (["k2"], ["Still Life"], ["kX"])
    assert (fixed["a4"]["new_ids"], fixed["a4"]["invalid_labels"]) == ([], ["Nothing"])


def test_duplicates(spark):
    items = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 2)], "g string, id int")
    barred = spark.createDataFrame([(1, 2)], "a int, b int")
    assert {tuple(r) for r in I.without_pairs(items, "id", barred, "g").select("g", "id").collect()} == {("g", 3)}
    moved = spark.createDataFrame([("b", "a")], "old string, new string")
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "id int, refs array<string>")
    assert {r["id"]: r["refs"] for r in I.repointed(rows, "id", "refs", moved).collect()} == {1: ["a", "c"], 2: []}


def test_versions(spark):
    saves = spark.createDataFrame([("c", 1, "n1"), ("c", 2, "n1"), ("c", 3, "n1n2"), ("c", 4, "n2n1"), ("c", 5, "n2n1"), ("d", 1, None)], "id string, at int, nodes string")
    assert sorted((r["version_at"], r["saved_at"]) for r in C.compacted(saves, "id", "at", "nodes").where("id = 'c'").collect()) == [(1, 2), (3, 3), (4, 5)]
    ids = spark.createDataFrame([("u-0",), ("u-7",), ("u-x",)], "id string")
    assert C.next_id(ids, "id").first()[0] == 8 and C.next_id(ids.where("false"), "id").first()[0] == 0
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    assert {tuple(r) for r in C.without_node(edges, "b").collect()} == {("a", "c"), ("c", "d")}
    nodes = spark.createDataFrame([("g", 0, "x", 0.0, 0.0), ("g", 1, "y", 10.0, 20.0)], "g string, pos int, content string, x double, y double")
    assert tuple(C.merged_nodes(nodes, "g").first()) == ("g", "x y", 5.0, 220.0)


def test_rewrites(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert {tuple(r) for r in U.insert_absent(table, rows, "k").collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert {r[0] for r in U.clashes(table, rows, "k").collect()} == {2, 3}
    assert {tuple(r) for r in U.upsert(table, rows.where("v <> 'e'"), "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in U.delete(table, rows, "k").collect()} == {(1, "a")}
    assert one(spark, U.literal(F.lit("o'x"))) == "'o''x'" and one(spark, U.literal(F.lit(None).cast("string"))) == "NULL"


def test_html(spark):
    page = """<html><head><title>T &amp; t</title><meta name="description" content="d"></head><body><h1>Big
      one</h1><p>First<br>second</p><span itemprop="date">1900</span><ul><li><s>Style:</s><a href="/s">Plain</a>, <a href="/s">x</a></li></ul><a href="/a/all-works">all</a></body></html>"""
    pages = spark.createDataFrame([(1, "http://h/x", page), (2, "http://h/y", None)], "id int, url string, html string")
    got = {r["id"]: r for r in H.fields(pages, "id", "html").collect()}
    assert (got[1]["title"], got[1]["h1"], got[1]["paragraph"], got[1]["description"]) == ("T & t", "Big one", "First", "d")
    assert got[1]["microdata"] == {"date": "1900"} and got[1]["labels"] == {"Style": "Plain, x"} and got[2]["title"] is None
    links = H.first_links(H.links(pages, "id", "url", "html"), "id", ~F.contains("href", F.lit("/all-works")), 1)
    assert [(r["href"], r["anchor"]) for r in links.collect()] == [("http://h/s", "Plain")]
    assert one(spark, H.embedded_json(F.lit("x ng-init='m = {&quot;a&quot;: 1}'"), "m")) == '{"a": 1}'


def test_embedder_and_thumbnails(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, " "), (3, "a b")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in E.embedded(rows, "id", "text", 16).collect()}
    assert set(got) == {1, 3} and got[1] == got[3] and np.linalg.norm(got[1]) == pytest.approx(1)
    stored = rows.where("id = 1").select("id")
    assert [r["id"] for r in E.missing(rows, stored, "id", "text", 16).collect()] == [3]
    sizes = F.expr("array(named_struct('width', 10, 'height', 10, 'url', 's'), named_struct('width', 40, 'height', 40, 'url', 'l'), named_struct('width', 20, 'height', 20, 'url', 'm'))")
    assert tuple(one(spark, S.thumbnails(sizes))) == ("s", "m", "l")


def test_lookup(spark):
    rows = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "k int, v string")
    assert [r["k"] for r in L.page(rows, "k", "v").collect()] == [1, 3, 2]
    assert [r["k"] for r in L.page(rows, "k", "nope", True, 2, 2).collect()] == [3]
    assert [r["k"] for r in L.by_ids(rows, [3, 9, 1, 3], "k").collect()] == [3, 1, 3]
    assert L.sample(rows, 2, 1, "k").count() == 2


def test_plans(spark):
    rows = spark.range(100).withColumn("v", F.col("id") % 7)
    plan = R.best_per_id(rows.select("id", F.col("v").cast("double").alias("distance"), (F.col("id") % 3).alias("q")), 3, "id", ["q"])._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
    plan = R.knn(spark.createDataFrame([("a", [1.0])], schema.VECTORS), [0.0], 1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


@pytest.mark.parametrize("most", [4, 100])
def test_knn_join_runs_queries_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_QUERIES", most)
    rng = random.Random(3)
    rows = [(i, [rng.random(), rng.random()]) for i in range(30)]
    index = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = R.knn_join(index, index.where("id % 2 = 0").withColumnRenamed("id", "query_id"), 3).collect()
    want = {(q, i, r) for q, v in rows[::2] for r, (_, i) in enumerate(sorted((math.dist(v, w), i) for i, w in rows)[:3], 1)}
    assert len(got) == 45 and {(r["query_id"], r["id"], r["rank"]) for r in got} == want


def test_adjacency_stats_counts_regions_and_pairs(spark, tmp_path):
    from lumenbase import plans

    at = [(0.0, 0.0), (1.0, 0.1), (0.2, 1.0), (0.9, 0.8), (0.5, 0.4), (0.3, 0.6), (0.7, 0.2)]
    spark.createDataFrame([(i, i, [*p]) for i, p in enumerate(at)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = plans.queries()["adjacency_stats"](spark, str(tmp_path)).first()
    merged = plans.queries()["merge_regions"](spark, str(tmp_path)).collect()
    assert len(merged) == 7 and got["possible"] == 21 and got["percentage"] == round(100 * got["actual"] / 21, 1)
    assert got["unpaired"] == sum(not r["merged"] for r in merged) and got["unpaired"] % 2 == 1


def test_blocks_give_the_same_rows(spark):
    """Centroids in successive blocks, owners cut into blocks, a hot owner among them."""
    import numpy as np

    from lumenbase.operators import retrieval as R

    rng = np.random.default_rng(4)
    rows = [(i, 0 if i % 3 else i % 7, rng.standard_normal(6).tolist()) for i in range(60)] + [(900, 0, [0.0] * 6), (901, 0, None)]
    df = spark.createDataFrame(rows, "id int, owner int, v array<double>")
    centres = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(7)], "c int, v array<double>")
    near = [sorted(map(tuple, R.nearest_centroid(df, centres, "id", "v", "c", most).collect())) for most in (10_000, 3)]
    assert near[0] == near[1] and len(near[0]) == 61
    pairs = [{(r["owner"], r["a"], r["b"], round(r["similarity"], 9)) for r in R.similar_pairs(df, "owner", "id", "v", 0.2, block).collect()} for block in (1000, 4)]
    good = {i: (o, np.array(v)) for i, o, v in rows if v and any(v)}
    want = {(o, a, b, round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9)) for a, (o, x) in good.items() for b, (p, y) in good.items() if a < b and o == p and x @ y > 0.2 * np.linalg.norm(x) * np.linalg.norm(y)}
    assert pairs[0] == pairs[1] == want


@pytest.mark.parametrize("name", ["nearest_centroid", "point_in_polygon", "orphan_refs", "merge_repoints_references", "pairwise_similar_in_group"])
def test_no_nested_loops(spark, name):
    from lumenbase import plans

    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_large_and_small_regions(spark):
    """Points in regions whose boxes differ by a thousand times, against ray casting in plain Python."""
    import random

    from lumenbase.operators import geometry as G

    rng = random.Random(2)
    shapes = [(0, [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0)])] + [(i, [(x, y), (x + 0.1, y), (x + 0.05, y + 0.1)]) for i in range(1, 20) for x, y in [(rng.uniform(-2, 2), rng.uniform(-2, 2))]]
    spots = [(i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(400)]
    regions = spark.createDataFrame([(r, [{"x": x, "y": y} for x, y in p]) for r, p in shapes], "region int, vertices array<struct<x:double,y:double>>")
    got = {(r["id"], r["region"]) for r in G.inside(spark.createDataFrame(spots, "id int, x double, y double"), regions).collect()}
    cross = lambda x, y, p: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, p[1:] + p[:1])) % 2
    assert got == {(i, r) for i, x, y in spots for r, p in shapes if cross(x, y, p)}
