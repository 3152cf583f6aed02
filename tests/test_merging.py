"""Classes of duplicates, merges through all tables, removal of nodes, quantiles of large groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbase.operators import canvas as C
from lumenbase.operators import merging as M
from lumenbase.operators import quantiles as Q


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in list(parent)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_classes(spark, kind):
    rng = np.random.default_rng(3)
    name = (lambda i: int(i)) if kind == "long" else (lambda i: f"id{i:04d}")
    pairs = [(i, i + 1) for i in range(100, 160)] + [(300, i) for i in range(301, 340)] + [tuple(p) for p in rng.integers(400, 520, (70, 2)).tolist()] + [(7, 7), (9, 8), (9, 8)]
    pairs = [(name(a), name(b)) for a, b in pairs]
    df = spark.createDataFrame([*pairs, (None, pairs[0][0])], f"a {kind}, b {kind}").repartition(3)
    assert {r["key"]: r["root"] for r in M.classes(df).collect()} == roots([p for p in pairs if p[0] != p[1]])
    assert M.classes(df.where("false")).count() == 0


def test_links(spark):
    rows = spark.createDataFrame([(3, "A", 1), (1, "a", 1), (2, "a", 2), (4, None, 1), (5, None, 1), (6, "a", 1), (None, "a", 1)], "id long, name string, place int")
    assert sorted(map(tuple, M.linked(rows, "id", [F.lower("name"), "place"]).collect())) == [(1, 3), (1, 6)]
    pairs, parted = (spark.createDataFrame(p, "a long, b long") for p in ([(1, 3), (1, 6)], [(6, 1)]))
    assert [tuple(r) for r in M.without_links(pairs, parted).collect()] == [(1, 3)]


def test_merge_carries_through(spark):
    """A chain a~b~c leaves one row; arrays, references and vectors follow and nothing dangles."""
    rows = spark.createDataFrame(
        [("a", 1.0, "short", None, ["x"]), ("b", 3.0, "a longer text", None, ["y", "x"]), ("c", 2.0, "mid text", "1900", None), ("d", 9.0, "alone", "1800", ["z"]), ("e", 1.0, "pair", "1700", []), ("f", 1.0, "pear", None, None)],
        "id string, score double, text string, date string, keywords array<string>",
    )
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("f", "e"), ("zz", "d")], "a string, b string")
    images = spark.createDataFrame([("i1", ["a", "b", "d"]), ("i2", ["c"]), ("i3", []), ("i4", None)], "image_id string, refs array<string>")
    uses = spark.createDataFrame([(1, "a"), (2, "d"), (3, "f"), (4, None)], "n int, used string")
    vectors = spark.createDataFrame([(k, [1.0]) for k in "abcdef"], "id string, v array<double>")
    out = M.merge_everywhere(rows, "id", M.classes(links), "score", {"images": (images, "image_id", "refs")}, {"uses": (uses, "used")}, {"vectors": (vectors, "id")}, longest=["text"], filled=["date"], united=["keywords"])
    assert {r["old"]: r["new"] for r in out["moved"].collect()} == {"a": "b", "c": "b", "f": "e"}
    assert {tuple(r)[:4] + (tuple(r["keywords"] or ()),) for r in out["rows"].collect()} == {("b", 3.0, "a longer text", "1900", ("x", "y")), ("d", 9.0, "alone", "1800", ("z",)), ("e", 1.0, "pair", "1700", ())}
    assert {r["image_id"]: r["refs"] for r in out["images"].collect()} == {"i1": ["b", "d"], "i2": ["b"], "i3": [], "i4": None}
    assert {r["n"]: r["used"] for r in out["uses"].collect()} == {1: "b", 2: "d", 3: "e", 4: None}
    assert sorted(r["id"] for r in out["vectors"].collect()) == ["b", "d", "e"]
    assert M.dangling(out["rows"], "id", out["images"], "image_id", "refs").count() == 0 and M.dangling(out["rows"], "id", images, "image_id", "refs").count() == 2
    names = spark.createDataFrame([("Ann", "Anna")], "old string, new string")
    held = spark.createDataFrame([(1, ["Ann", "Bob", "Anna"])], "id int, names array<string>")
    assert M.renamed(held, "id", "names", names).first()["names"] == ["Anna", "Bob"]


def one_after_another(edges, nodes):
    edges = set(edges)
    for n in nodes:
        into, out = {a for a, b in edges if b == n and a != n}, {b for a, b in edges if a == n and b != n}
        edges = {(a, b) for a, b in edges if n not in (a, b)} | {(a, b) for a in into for b in out}
    return edges


def test_nodes_removed_in_any_order(spark):
    rng = np.random.default_rng(5)
    for n, m, k in ((8, 14, 4), (25, 50, 14), (40, 45, 30)):
        edges = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, n, (m, 2)).tolist()}
        gone = [f"n{i}" for i in rng.permutation(n)[:k].tolist()]
        want = one_after_another(edges, gone)
        assert want == one_after_another(edges, gone[::-1])
        got = C.without_nodes(spark.createDataFrame(sorted(edges), "source string, target string"), spark.createDataFrame([(g,) for g in [*gone, gone[0]]], "node string"))
        assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in C.without_node(spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "b")], "source string, target string"), "b").collect()} == {("a", "c")}


@pytest.mark.parametrize("buckets, most", [(256, 10_000), (4, 10), (16, 1)])
def test_quantiles(spark, buckets, most):
    """One group with nine tenths of the rows, ties, a group of one, null groups and values."""
    rng = np.random.default_rng(2)
    values = {"hot": rng.exponential(size=2700).round(3).tolist(), "tied": [1.0] * 90 + [2.0] * 60, "one": [4.5], None: rng.normal(size=150).tolist(), "two": [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in [*vs, None]] + [("none", None)], "g string, v double").repartition(5)
    for share in (0.0, 0.5, 0.9, 1.0):
        got = {r["g"]: r["quantile"] for r in Q.quantile_by(df, "g", "v", share, buckets, most).collect()}
        assert got == {g: pytest.approx(np.quantile(vs, share), abs=1e-12) for g, vs in values.items()}
    assert Q.quantile_by(df.where("false"), "g", "v", 0.9).count() == 0
