"""Staged documents, repairs with counters, linked sources, saves by interval."""

import http.server
import json
import threading
import time
from functools import partial

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from lumenbase.operators import repairs as R
from lumenbase.sources.paged import LinkedReader, register
from lumenbase.streaming import jobs, staged


def document(name, works, **more):
    return json.dumps({"metadata": {}, "artist": {"name": name, "artworks": [{"image_id": w, "value": f"{name} {w}", "artist_names": [name], "image_urls": {"small": "s"}} for w in works], **more}})


def run(spark, tmp_path, store="store"):
    staged.stream(spark, str(tmp_path / "staging"), str(tmp_path / "completed"), str(tmp_path / store), str(tmp_path / f"mark-{store}")).awaitTermination()


def rows(store):
    return {name: sorted(map(tuple, store.table(name).drop("batch").collect()), key=repr) for name in staged.TABLES}


def test_staged_stream(spark, tmp_path):
    """Documents become rows of two tables; finished files end in the archive; a second run adds and updates."""
    (tmp_path / "staging").mkdir()
    put = lambda name, text: (tmp_path / "staging" / name).write_text(text)
    put("a.json", document("Ann", ["i1", "i2"], generated_entry_id="e1", RelatedKeywordIds=["k"], descriptions={"web": {"birth": "1900"}}))
    put("b.json", "{ no document")
    put("c.json", document("Bob", [], existing_id="e2", is_existing=True))
    run(spark, tmp_path)
    store = staged.Store(spark, str(tmp_path / "store"))
    first = rows(store)
    assert [r[:5] for r in first["text_entries"]] == [("e1", "Ann", "[]", 1, "artist"), ("e2", "Bob", "[]", 1, "artist")]
    assert first["text_entries"][0][6:8] == ('{"web":{"birth":"1900"}}', '["k"]') and [r[0] for r in first["image_entries"]] == ["i1", "i2"]
    assert {r[2:] for r in first["applied"]} == {("e1", "INSERT"), ("i1", "INSERT"), ("i2", "INSERT"), ("e2", "UPDATE")}
    put("d.json", document("Ann the elder", ["i2", "i3"], existing_id="e1", is_existing=True))
    run(spark, tmp_path)
    second = rows(store)
    assert [(r[0], r[1]) for r in second["text_entries"]] == [("e1", "Ann the elder"), ("e2", "Bob")]
    assert [(r[0], r[1]) for r in second["image_entries"]] == [("i1", "Ann i1"), ("i2", "Ann the elder i2"), ("i3", "Ann the elder i3")]
    put("e.json", document("Cid", []))
    run(spark, tmp_path)
    moved = {p.name for p in (tmp_path / "completed").rglob("*.json")}
    assert moved >= {"a.json", "b.json", "c.json"} and not moved & {p.name for p in (tmp_path / "staging").iterdir()}
    assert len(rows(store)["text_entries"]) == 3
    totals = staged.export(store, str(tmp_path / "export")).first()
    assert (totals["total_artists"], totals["total_artworks"], totals["source_files"]) == (3, 3, 4)
    assert spark.read.json(str(tmp_path / "export" / "image_entries")).count() == 3


def test_staged_batch_breaks_and_runs_again(spark, tmp_path, monkeypatch):
    """A crash between the tables leaves the last version; the same batch again gives what it would have given at once."""
    lines = spark.createDataFrame([("a.json", document("Ann", ["i1"])), ("b.json", document("Bob", ["i1", "i4"]))], "file_name string, value string")
    more = spark.createDataFrame([("c.json", document("Cid", ["i1"]))], "file_name string, value string")
    whole, broken = (staged.Store(spark, str(tmp_path / n)) for n in ("whole", "broken"))
    for store in (whole, broken):
        store.apply(staged.documents(lines), 0)
    before = rows(broken)
    assert [r[:2] for r in before["image_entries"]] == [("i1", "Bob i1"), ("i4", "Bob i4")]
    real = broken.table
    calls = []

    def failing(name, state=None):
        calls.append(name)
        if name == "image_entries":
            raise OSError("lost")
        return real(name, state)

    monkeypatch.setattr(broken, "table", failing)
    with pytest.raises(OSError):
        broken.apply(staged.documents(more), 1)
    monkeypatch.undo()
    assert calls[-1] == "image_entries" and rows(broken) == before
    for store in (whole, broken, broken):  # again once committed: skipped
        store.apply(staged.documents(more), 1)
    assert rows(broken) == rows(whole) and broken.state()["batch"] == 1 and len(broken.table("applied").where("batch = 1").collect()) == 2


def test_by_slug(spark, tmp_path):
    staged.write_by_slug(spark.createDataFrame([("Zoë Ann", 1), ("zoe ann", 2), ("Bo", 3)], "name string, n int"), "name", str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "by_slug").glob("slug=*")) == ["slug=bo", "slug=zoe-ann"] and spark.read.json(str(tmp_path / "combined")).count() == 3


def test_json_repairs_count_in_one_pass(spark):
    texts = ['["a"]', "['a']", "plain", "{'k': 1}", '["a", ', None, "", "{oops}"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id int, list string, object string")
    out, seen = R.fixed_json(df, {"list": F.lit(True), "object": F.lit(False)})
    got = {r["id"]: (r["list"], r["object"]) for r in out.collect()}
    assert got[1] == ('["a"]', '["a"]') and got[2] == ('["plain"]', "plain") and got[4] == (texts[4], texts[4]) and got[5] == (None, None)
    assert seen.get == {"fixed_list": 3, "skipped_list": 2, "fixed_object": 2, "skipped_object": 3}


def test_corrections(spark):
    df = spark.createDataFrame([(1, ["a"], "x"), (2, ["b"], "y"), (3, None, "z"), (4, ["d"], None)], "id int, ids array<string>, name string")
    new = spark.createDataFrame([(1, ["a", "c"], "x"), (2, ["b"], None), (3, ["q"], "z2"), (9, ["no"], "no")], "id int, ids array<string>, name string")
    out, seen = R.corrected(df, "id", new, ["ids", "name"])
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, ["a", "c"], "x"), (2, ["b"], "y"), (3, ["q"], "z2"), (4, ["d"], None)]
    assert seen.get == {"fixed": 2, "same": 1}


def test_url_repairs(spark):
    df = spark.createDataFrame([(1, {"small": " https://h.org/a ", "large": "h.org/b", "medium": ""}), (2, {"small": "//c.net"}), (3, None), (4, {"small": "https://ok.org", "large": None, "tall": "nonsense"})], "id int, urls map<string,string>")
    out, seen = R.fixed_urls(df, "urls")
    got = {r["id"]: r["urls"] for r in out.collect()}
    assert got == {1: {"small": "https://h.org/a", "large": "https://h.org/b"}, 2: {"small": "https://c.net"}, 3: None, 4: {"small": "https://ok.org"}}
    assert seen.get == {"fixed": 3, "dropped": 3}


def test_outcomes(spark):
    df = spark.createDataFrame([("ok",), ("ok",), ("failed",), (None,)], "outcome string")
    assert {r["outcome"]: r["n"] for r in R.outcomes(df, "outcome").collect()} == {"ok": 2, "failed": 1, None: 4}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Two pages of artworks; artists of one, none of another, a broken link, no link, a link without the list."""
    root = tmp_path_factory.mktemp("tree")
    link = lambda rel, href: {"_links": {rel: {"href": href}}}
    item = lambda i, href=None: {"id": i, **(link("artists", href) if href else {})}
    put = lambda name, value: (root / name).write_text(json.dumps(value))
    put("p0.json", {"items": [item("w1", "a1.json"), item("w2", "missing.json")], **link("next", "p1.json")})
    put("p1.json", {"items": [item("w3"), item("w4", "a4.json"), item("w5", "p0.json")], **link("next", "p0.json")})
    put("a1.json", {"_embedded": {"artists": [{"id": "x", "name": "Ann"}, {"id": "y"}]}})
    put("a4.json", {"_embedded": {"artists": []}})
    return root


@pytest.fixture(scope="module")
def site(tree):
    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), partial(Quiet, directory=str(tree)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("remote", [False, True])
def test_sub_resources(spark, tree, site, remote):
    register(spark)
    first = f"{site}/p0.json" if remote else str(tree / "p0.json")
    assert sorted(r["id"] for r in spark.read.format("paged_json").option("path", first).load().collect()) == ["w1", "w2", "w3", "w4", "w5"]
    read = lambda: spark.read.format("linked_json").option("path", first).option("rel", "artists").option("parents", 2).load()
    out = read().collect()
    assert {(r["parent_id"], r["id"]) for r in out if r["error"] is None} == {("w1", "x"), ("w1", "y")}
    errors = {r["parent_id"]: r["error"] for r in out if r["error"]}
    assert set(errors) == {"w2", "w3"} and errors["w3"] == "no link" and errors["w2"].startswith(("HTTPError", "FileNotFoundError"))
    assert json.loads(next(r["item"] for r in out if r["id"] == "x"))["name"] == "Ann"


def test_ids_are_pushed_down(spark, tree):
    register(spark)
    read = spark.read.format("linked_json").option("path", str(tree / "p0.json")).option("rel", "artists").load()
    assert {r["id"] for r in read.where("parent_id = 'w1'").collect()} == {"x", "y"}
    assert [r["error"] for r in read.where("parent_id in ('w3', 'zz')").collect()] == ["no link"]
    assert [type(f).__name__ for f in LinkedReader({"path": "", "rel": "artists"}).pushFilters([EqualTo(("parent_id",), "w1"), EqualTo(("id",), "x")])] == ["EqualTo"]


def test_interval_saves(spark, tmp_path):
    """A burst is saved once when its interval ends; what comes later is saved in the next; a restart saves nothing twice."""
    source, mark, out = (str(tmp_path / n) for n in ("in", "mark", "out"))
    put = lambda items: spark.createDataFrame(pd.DataFrame(items, columns=["id", "blob"])).coalesce(1).write.mode("append").parquet(source)
    put([("c", "1"), ("c", "2"), ("d", "1")])

    def start():
        stream = spark.readStream.schema("id string, blob string").parquet(source)
        return jobs.interval_saves(stream, "id", "blob", 2000).writeStream.format("parquet").outputMode("append").option("checkpointLocation", mark).trigger(processingTime="500 milliseconds").start(out)

    def saved(n):
        for _ in range(120):
            time.sleep(0.5)
            try:
                found = sorted((r["id"], r["blob"], r["n"]) for r in spark.read.schema("id string, blob string, n long").parquet(out).collect())
            except Exception:
                continue
            if len(found) >= n:
                return found
        return found

    query = start()
    assert saved(2) == [("c", "2", 2), ("d", "1", 1)]
    query.stop()
    query = start()
    put([("c", "3")])
    assert saved(3) == [("c", "2", 2), ("c", "3", 1), ("d", "1", 1)]
    query.stop()


def test_api_log_as_a_stream(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    line = "[2025-01-01T00:0{}:00Z] API Call: {} /x | Body: {{}} | Query: {{}} | Params: {{}}"
    (source / "a.txt").write_text("\n".join([line.format(0, "GET"), line.format(0, "GET"), "junk", line.format(1, "POST"), line.format(9, "GET")]))
    calls = jobs.api_calls(spark.readStream.text(str(source)))
    query = jobs.calls_per_minute(calls).writeStream.format("memory").queryName("calls").outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["method"], r["n"]) for r in spark.sql("SELECT * FROM calls").collect()) == [("GET", 2), ("POST", 1)]
