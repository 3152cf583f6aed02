"""Readers and streaming jobs on files written here."""

import json

import pandas as pd
import pytest

from lumenbase.operators import embed as E
from lumenbase.sources import files
from lumenbase.sources.paged import PagedSource
from lumenbase.streaming import jobs


def test_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("id,gene name\n1,x\n")
    assert files.csv_with(spark, str(tmp_path / "g.csv"), ["id"]).count() == 1
    with pytest.raises(ValueError):
        files.csv_with(spark, str(tmp_path / "g.csv"), ["gene family"])
    (tmp_path / "n.txt").write_text(" Ada \n\nBo\n")
    assert [r[0] for r in files.names(spark, str(tmp_path / "n.txt")).collect()] == ["Ada", "Bo"]
    (tmp_path / "log").write_text("# head\nAda|SUCCESS|t1\nBo|FAILED|t2|why\n")
    assert {r["name"] for r in files.progress_log(spark, str(tmp_path / "log")).collect()} == {"Ada", "Bo"}
    (tmp_path / "pairs").write_text("b,a\na,b\n")
    assert [tuple(r) for r in files.pair_list(spark, str(tmp_path / "pairs")).collect()] == [("a", "b")]
    line = "[2025-01-01T00:00:00Z] API Call: POST /x | Body: {\"a\":1} | Query: {} | Params: {}"
    row = files.api_log(spark.createDataFrame([(line,), ("junk",)], "value string")).collect()
    assert [(r["method"], r["url"], r["body"]) for r in row] == [("POST", "/x", '{"a":1}')]
    export = spark.createDataFrame([('{"t1": "old", "t2": "new"}',)], "e string")
    assert files.exported_version(export, "e").first()["content"] == "new" and files.exported_version(export, "e", "t1").first()["content"] == "old"
    blob = json.dumps({"nodes": [{"id": "n1", "type": "text", "position": {"x": 1, "y": 2}, "data": {"content": "c"}}], "edges": []})
    versions = spark.createDataFrame([("v", "c", "t", blob)], "versionId string, canvasId string, timestamp string, jsonBlob string")
    assert tuple(files.canvas_nodes(versions).first()) == ("c", "t", "n1", "text", "c", 1.0, 2.0)


def test_paged(spark, tmp_path):
    for i in range(3):
        link = {"next": {"href": f"p{i + 1}.json"}} if i < 2 else {}
        (tmp_path / f"p{i}.json").write_text(json.dumps({"items": [{"id": i}], "_links": link}))
    spark.dataSource.register(PagedSource)
    read = lambda depth: spark.read.format("paged_json").option("path", str(tmp_path / "p0.json")).option("max_depth", depth).load()
    assert sorted(r["id"] for r in read(0).collect()) == ["0", "1", "2"] and read(2).count() == 2


def test_incremental(spark, tmp_path):
    source, store, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    rows.write.parquet(source)
    run = lambda: jobs.incremental(spark.readStream.schema("id int, text string").parquet(source), store, lambda d: E.embedded(d, "id", "text", 8), "id", mark).awaitTermination()
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], "id int, text string").write.mode("append").parquet(source)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(store).collect()) == [1, 2, 3]


def test_stream_compaction(spark, tmp_path):
    source = str(tmp_path / "in")
    frame = pd.DataFrame({"id": ["c"] * 4, "at": pd.to_datetime(["2025-01-01 00:00:0%d" % i for i in range(4)]), "nodes": ["a", "a", "b", "a"]})
    spark.createDataFrame(frame).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id string, at timestamp, nodes string").parquet(source)
    query = jobs.compaction(stream, "id", "at", "nodes").writeStream.format("memory").queryName("compacted").outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["version"] for r in spark.sql("SELECT * FROM compacted ORDER BY saved_at").collect()] == [0, 0, 1, 2]


def test_autosaves(spark, tmp_path):
    source = str(tmp_path / "in")
    times = ["00:00:00.0", "00:00:00.5", "00:00:05.0", "00:01:00.0"]
    spark.createDataFrame(pd.DataFrame({"id": ["c"] * 4, "at": pd.to_datetime(["2025-01-01 " + t for t in times])})).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id string, at timestamp").parquet(source)
    query = jobs.autosaves(stream, "id", "at").writeStream.format("memory").queryName("saves").outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.sql("SELECT * FROM saves").collect()) == [1, 2]
