"""Records: names, dates, clippings, staged artists, exports, caches."""

import json

from pyspark.sql import functions as F

from lumenbase.operators import records as R


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_names(spark):
    texts = ['["A, b", "C"]', "A,  b, C", "", None, "[broken, list", "single", '["x", null]', "[]"]
    got = one(spark, [(t,) for t in texts], "t string", R.names_of(F.col("t")))
    assert [g[0] for g in got] == [["A, b", "C"], ["A", "b", "C"], [], [], ["[broken", "list"], ["single"], ["x"], []]


def test_descriptions(spark):
    rows = [({"a": {"x": "1"}, "b": {"date": "1900", "art_form": "oil"}, "c": {"date": "1901", "art_form": "oil", "description": "d"}},), ({},), (None,)]
    got = one(spark, rows, "d map<string,map<string,string>>", R.dated(F.col("d")), R.shown(F.col("d")))
    assert got[0][0] == "1900" and [tuple(e) for e in got[0][1]] == [("X", "1"), ("Art form", "oil")] and got[1] == (None, []) and got[2] == (None, None)
    typed = spark.createDataFrame([("k1", "Sea", [{"value": "ocean"}, {"name": "mer"}, {"z": "q"}], rows[0][0])], "id string, v string, al array<map<string,string>>, d map<string,map<string,string>>")
    k = typed.select(R.keyword(F.col("id"), F.col("v"), F.col("al"), F.col("d")).alias("k")).first()["k"]
    assert (k["entryId"], k["value"], k["aliases"], len(k["descriptions"])) == ("k1", "Sea", ["ocean", "mer"], 3)


def test_staged_artists_by_slug(spark):
    df = spark.createDataFrame([([("Zoë B", 1), ("Al", 2), (None, 3)], ("zoe b", 9))], "items array<struct<name:string,n:int>>, item struct<name:string,n:int>")
    r = df.select(R.by_slug(F.col("items"), "zoe-b")["n"].alias("a"), R.without_slug(F.col("items"), "zoe-b").alias("b"), R.with_slug(F.col("items"), F.col("item")).alias("c"), R.by_slug(F.col("items"), "none").alias("d")).first()
    assert r["a"] == 1 and [x["n"] for x in r["b"]] == [2, 3] and [x["n"] for x in r["c"]] == [9, 2, 3] and r["d"] is None


def test_clippings(spark):
    df = spark.createDataFrame([([("1", "text"), ("2", "image")], ("3", "text"), ("1", "text"))], "c array<struct<id:string,type:string>>, new struct<id:string,type:string>, old struct<id:string,type:string>")
    c = F.col("c")
    r = df.select(R.with_clipping(c, F.col("new")).alias("a"), R.with_clipping(c, F.col("old")).alias("b"), R.without_clipping(c, F.lit("1")).alias("c2"), R.of_type(c, "image").alias("d")).first()
    ids = lambda x: [i["id"] for i in x]
    assert (ids(r["a"]), ids(r["b"]), ids(r["c2"]), ids(r["d"])) == (["1", "2", "3"], ["1", "2"], ["2"], ["2"])


def test_merged_edges_queues_and_keywords(spark):
    merged = spark.createDataFrame([("a", "m"), ("b", "m"), ("m", "m")], "node string, into string")
    assert sorted(map(tuple, R.merged_edges(merged).collect())) == [("a", "m"), ("b", "m")]
    queue, parted = spark.createDataFrame([(1, "done"), (2, "skipped")], "id int, status string"), spark.createDataFrame([(1, 2)], "a int, b int")
    for forget in (False, True):
        q, p = R.reset_queue(queue, "id", "status", parted, forget)
        assert {tuple(r) for r in q.collect()} == {(1, "pending"), (2, "pending")} and p.count() == (0 if forget else 1)
    lists = [(["a"], ["b"]), ([], ["b"]), (None, ["b"]), (None, None)]
    assert [g[0] for g in one(spark, lists, "x array<string>, y array<string>", R.keyword_chain(F.col("x"), F.col("y")))] == [["a"], ["b"], ["b"], []]


def test_region_members_first(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(9)], "id int, region int")
    assert sorted(map(tuple, R.region_members(df, "region", "id", 2).collect())) == [(0, 0, 0), (0, 1, 2), (1, 0, 1), (1, 1, 3)]


def test_export(spark):
    rows = [(1, '{"a": [1, 2]}', 'say "hi"\n', None, 1.5), (2, "{broken", "[1]", ["x"], None), (3, None, "", [], 2.0)]
    df = spark.createDataFrame(rows, "id int, `odd name` string, t string, l array<string>, d double")
    got = [json.loads(r["value"]) for r in R.exported(df).orderBy("value").collect()]
    assert got == [{"id": 1, "odd name": {"a": [1, 2]}, "t": 'say "hi"\n', "l": None, "d": 1.5}, {"id": 2, "odd name": "{broken", "t": [1], "l": ["x"], "d": None}, {"id": 3, "odd name": None, "t": "", "l": [], "d": 2.0}]


def test_cache_by_parameters(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    get = lambda p, **o: R.cached(spark, str(tmp_path), p, make, **o)
    assert get({"n": 1, "k": [2]})[1] is False and get({"k": [2], "n": 1})[1] is True and get({"n": 2, "k": [2]})[1] is False and len(calls) == 2
    assert get({"n": 1, "k": [2]}, fresh=True)[1] is False and get({"n": 1, "k": [2]})[0].count() == 3 and len(calls) == 3


def test_remake(spark, tmp_path):
    store = str(tmp_path / "s")
    put = lambda rows, remake: R.remade(spark.createDataFrame(rows, "id int, v string"), store, remake, "id")
    put([(1, "a"), (2, "b")], False)
    put([(2, "changed"), (3, "c")], False)
    assert {tuple(r) for r in spark.read.parquet(store).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    put([(9, "z")], True)
    assert {tuple(r) for r in spark.read.parquet(store).collect()} == {(9, "z")}


def test_files(spark, tmp_path):
    from lumenbase.sources import files

    rows = spark.createDataFrame([("Ada", "SUCCESS", "t1", None), ("Bo", "FAILED", "t2", "why")], "name string, status string, at string, message string")
    files.append_progress(rows, str(tmp_path / "log"))
    files.append_progress(rows.where("name = 'Bo'"), str(tmp_path / "log"))
    assert sorted((r["name"], r["message"]) for r in files.progress_log(spark, str(tmp_path / "log")).collect()) == [("Ada", None), ("Bo", "why"), ("Bo", "why")]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"12345")
    assert [tuple(r) for r in files.image_files(spark, str(tmp_path / "img")).collect()] == [("a.png", 5)]
    for i, name in enumerate(("old.json", "new.json")):
        (tmp_path / name).write_text('{"artist": {"name": "%s"}}' % name)
        import os

        os.utime(tmp_path / name, (1_000_000 + i * 1000,) * 2)
    staged = files.staged(spark, str(tmp_path / "*.json"))
    assert files.newest_file(staged).first()["file_name"] == "new.json" and staged.count() == 2


def test_grid_alignment():
    """A layout turned and scaled onto a grid keeps its shape."""
    import numpy as np

    from lumenbase.operators import geometry as G

    rng = np.random.default_rng(2)
    points = rng.standard_normal((25, 2))
    out = G.procrustes_to_grid(points)
    near = lambda p: np.sort(((p[:, None] - p[None]) ** 2).sum(2)[np.triu_indices(25, 1)])
    a, b = near(points), near(out)
    assert out.shape == (25, 2) and np.allclose(a / a.sum(), b / b.sum()) and np.allclose(out.mean(0), 0)
    angle = 0.7
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    assert np.allclose(G.procrustes_to_grid(points @ turn * 3 + 5), out)


def test_exported_images_and_summaries(spark, tmp_path):
    import pytest

    from lumenbase.operators import canvas as C
    from lumenbase.sources import files

    node = lambda i, kind, **data: {"id": i, "type": kind, "data": data}
    export = {"t1": {"nodes": [node("a", "image", content="u1", provenance="ai", prompt="p"), node("b", "text", content="x", provenance="ai"), node("c", "image", content="u2")]}, "t2": {"nodes": [node("d", "image", content="u3", provenance="ai")]}}
    df = spark.createDataFrame([(json.dumps(export),)], "e string")
    assert [tuple(r) for r in files.ai_images(df, "e", "t1").collect()] == [("t1", 0, "a", "u1", "p")]
    for version in (None, "missing"):
        assert [tuple(r) for r in files.ai_images(df, "e", version).collect()] == [("t2", 0, "d", "u3", "")]
    (tmp_path / "one.json").write_text('{"metadata": {"timestamp": "t", "total_artists": "3", "limit": "x"}}')
    read = lambda name: files.one_staged(spark, str(tmp_path), name, "metadata map<string,string>")
    assert tuple(files.run_summary(read("../../up/one.json")).first()) == ("t", 0, 3, 0, 0, 0, 0, False)
    for bad in ("..", "/etc/passwd", ".json", "a\\..\\"):
        with pytest.raises(ValueError):
            read(bad)
    boxes = spark.createDataFrame([(i, 5.0, 7.0, 100.0, 50.0) for i in range(50)], "id int, x double, y double, width double, height double")
    got = C.nearby(boxes, "id", 3).collect()
    assert all(35 <= r["x"] <= 75 and 57 <= r["y"] <= 97 for r in got) and len({r["x"] for r in got}) == 50 and got == C.nearby(boxes.repartition(3), "id", 3).orderBy("id").collect()
