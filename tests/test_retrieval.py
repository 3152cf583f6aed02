"""Neighbour joins against brute force, broadcast and in blocks; counted phrases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbase.operators import keywords as K
from lumenbase.operators import retrieval as R


def nearest(index, queries, k):
    out = set()
    for q, v in queries:
        if v is not None:
            d = sorted((float(np.sqrt(((np.array(x) - v) ** 2).sum())), i) for i, x in index if x is not None)[:k]
            out |= {(q, i, round(dist, 9), r) for r, (dist, i) in enumerate(d, 1)}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 12)).round(1) + 1000.0
    x[50:60] = x[7]  # ties
    index = [(f"k{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("none", None)]
    queries = [(i, (v + 0.05).tolist()) for i, v in enumerate(x[::9])] + [(900, x[7].tolist()), (901, None)]
    return index, queries


@pytest.mark.parametrize("most, block", [(1 << 25, 4096), (0, 4096), (0, 37)])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_knn_join(spark, monkeypatch, vectors, most, block, k):
    monkeypatch.setattr(R, "MOST_BYTES", most)
    monkeypatch.setattr(R, "BLOCK_ROWS", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 23)
    try:
        index, queries = (spark.createDataFrame(rows, f"{key}, embedding array<double>").repartition(3) for rows, key in zip(vectors, ("id string", "query_id long")))
        got = {(r["query_id"], r["id"], round(r["distance"], 9), r["rank"]) for r in R.knn_join(index, queries, k).collect()}
        assert got == nearest(*vectors, k)
        assert R.knn_join(index, queries.where("false"), k).count() == 0 and R.knn_join(index.where("false"), queries, k).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("most", [1 << 25, 0])
def test_nearest_centroid(spark, monkeypatch, vectors, most):
    monkeypatch.setattr(R, "MOST_BYTES", most)
    index, queries = vectors
    points = spark.createDataFrame(index, "id string, v array<double>")
    centroids = spark.createDataFrame([*queries, (902, queries[0][1])], "centroid_id long, v array<double>")
    got = {(r["id"], r["centroid_id"], round(r["distance"], 9)) for r in R.nearest_centroid(points, centroids, "id", "v").collect()}
    assert got == {(q, i, d) for q, i, d, _ in nearest([*queries, (902, queries[0][1])], index, 1)}
    assert R.nearest_centroid(points.where("false"), centroids, "id", "v").count() == 0


def test_details_keep_their_order(spark):
    found = spark.createDataFrame([("b", 0.5), ("a", 2.0), ("c", 1.0)], "id string, distance double")
    details = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, n int").repartition(4)
    assert [r["id"] for r in R.with_details(found, details).collect()] == ["b", "c", "a"]


@pytest.mark.parametrize("bound", [500_000, 0])
def test_counted_phrases(spark, bound):
    """Phrases looked up in texts, and beyond the bound joined with their n-grams."""
    texts = ["a b c a b", None, "", "A  b\tc d", "x", "b c b c b c"]
    phrases = ["a b", "b", "b c d", "zz", "a b c d", "x", None, "c b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    wanted = spark.createDataFrame([(p,) for p in [*phrases, "x"]], "phrase string")
    want = {}
    for t in texts:
        w = (t or "").lower().split()
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                if (p := " ".join(w[i : i + n])) in phrases:
                    want[p] = want.get(p, 0) + 1
    assert {r["phrase"]: r["n"] for r in K.counted(df, "text", wanted, 3, bound).collect()} == want


def test_spans_without_entries(spark):
    grams = spark.createDataFrame([(1, "a", 0, 0), (1, "b", 1, 1)], "id int, phrase string, start int, stop int")
    matches = spark.createDataFrame([("a", 5, 0.5), ("a", 4, 0.5), ("b", 6, 0.1)], "phrase string, id long, similarity double")
    assert [(r["phrase"], r["id"]) for r in K.candidates(grams.withColumnRenamed("id", "text_id"), matches, None, 0.25).collect()] == [("a", 4)]
    assert K.candidates(grams.withColumnRenamed("id", "text_id"), matches, spark.createDataFrame([(5,)], "id long"), 0.25).select(F.col("id")).first()[0] == 5


def test_stored_and_inherited_keywords(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    stored = make([("a", f"s{i}", i) for i in range(6)] + [("b", "s0", 0), ("b", "s0", 3)], "id string, keyword_id string, pos int")
    found = make([("a", "f1", 0.2, 1), ("a", "s2", 0.1, 2), ("a", "f2", 0.3, 3), ("c", "f1", 0.4, 1)], "id string, keyword_id string, distance double, rank int")
    lists = K.after_stored(stored, found, "id", True).collect()
    of = lambda key: [r["keyword_id"] for r in sorted((r for r in lists if r["id"] == key), key=lambda r: r["rank"])]
    assert of("a") == ["s0", "s1", "s2", "s3", "s4", "s5", "f1"] and of("b") == ["s0"] and of("c") == ["f1"]
    works = make([("w", "a"), ("w", "c"), ("x", "zz")], "work string, id string")
    got = K.inherited(works, make([(r["id"], r["keyword_id"], r["rank"]) for r in lists], "id string, keyword_id string, rank int"), "id", "work").collect()
    assert {(r["work"], r["keyword_id"]): r["pos"] for r in got} == {("w", k): (1 if k == "f1" else i + 1) for i, k in enumerate(of("a"))}


def test_search_parts(spark):
    rows = spark.createDataFrame([(1, {"genre": "Marina, , portrait", "style": "marina"}), (2, {}), (3, None)], "id int, details map<string,string>")
    got = K.search_parts(rows, "id", "details", {"marina": ["nautical"], "x": ["y", "z"]}).collect()
    assert {tuple(r) for r in got} == {(1, "Marina", False), (1, "portrait", False), (1, "marina", False), (1, "nautical", True)} and len(got) == 4
