"""Duplicates merged as classes: links between rows become connected classes, and one rewrite carries a merge through all tables.

Pairs of duplicates chain: if a is b and b is c, one of the three stays. Links come from names (``linked``), vectors or reviewers;
pairs that a reviewer has parted are taken out first (``without_links``), but rows stay in one class if other links join them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written
from .integrity import edges, repointed, repointed_rows


def linked(rows: DataFrame, key: str, by: list[str | Column]) -> DataFrame:
    """(a, b): links from each row of a group to the group's first key, one a row whatever the group's size; null groups link nothing."""
    names = [f"_g{i}" for i in range(len(by))]
    keyed = rows.select(F.col(key).alias("b"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(by, names)]).dropna(subset=["b", *names])
    first = keyed.groupBy(*names).agg(F.min("b").alias("a"), F.count("*").alias("_n")).where("_n > 1")
    return keyed.join(first, names).where("a <> b").select("a", "b").distinct()


def without_links(pairs: DataFrame, parted: DataFrame) -> DataFrame:
    """Links (a, b) less those that a reviewer parted, whichever way they are written."""
    both = parted.select("a", "b").union(parted.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def classes(pairs: DataFrame) -> DataFrame:
    """(key, root): each key of the links (a, b) with the smallest key of its class.

    In a round each node joins the neighbour, or itself, that comes first in the order of a hash, and the links are drawn between
    what is left; the hash makes chains short, so a constant share of the nodes goes in a round on average. Each round is a written
    table; nothing is gathered by class."""
    spark = pairs.sparkSession
    kind = pairs.schema["a"].dataType.simpleString()
    current = written(pairs.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    found, turn = None, 0
    while not current.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("k"))  # noqa: E731, B023
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a"))).alias("f")).select(F.col("a").alias("node"), F.col("f.k").alias("to")))
        new = found.join(step, found["at"] == step["node"], "left").select("key", F.coalesce("to", "at").alias("at")) if found is not None else step.select(F.col("node").alias("key"), F.col("to").alias("at"))
        new = written(new)
        to = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        after = written(current.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        for old in (current, found, step):
            if old is not None:
                dropped(old)
        current, found = after, new
    if found is None:
        return spark.createDataFrame([], f"key {kind}, root {kind}")
    return found.join(found.groupBy("at").agg(F.min("key").alias("root")), "at").select("key", "root")


def survivors(rows: DataFrame, key: str, members: DataFrame, score: Column) -> DataFrame:
    """(old, new): the rows of each class (key, root) that go, and the one that stays: the best score, the first key on ties.

    The row that stays is a combined aggregate; members that are no rows are left out."""
    keyed = rows.select(F.col(key).alias("old"), score.alias("_score")).join(members.select(F.col("key").alias("old"), "root"), "old")
    best = keyed.groupBy("root").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("old").alias("new"))).alias("_best"))
    return keyed.join(best, "root").where(F.col("old") != F.col("_best.new")).select("old", F.col("_best.new").alias("new"))


def merged_rows(rows: DataFrame, key: str, moved: DataFrame, score: str, longest: list[str] = (), filled: list[str] = (), united: list[str] = ()) -> DataFrame:
    """The rows after a merge (old -> new): a row that stays takes the longest text of its class in some columns, what is missing in others
    from the best row that has it, and the union of arrays, sorted."""
    target = rows.join(moved.withColumnRenamed("old", key), key, "left").withColumn("_to", F.coalesce("new", key)).drop("new")
    touched = moved.select(F.col("new").alias("_to")).distinct()
    inside = target.join(touched, "_to", "left_semi")
    # the row that stays first, then by score and key
    rank = F.struct((F.col(key) != F.col("_to")).alias("o"), (-F.col(score)).alias("s"), F.col(key).alias("k"))
    parts = [F.max_by(c, F.struct(F.coalesce(F.length(c), F.lit(-1)), F.col(key) == F.col("_to"), F.col(score))).alias(f"_{c}") for c in longest]
    parts += [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_{c}") for c in filled]
    taken = inside.groupBy("_to").agg(F.count("*").alias("_n"), *parts)
    for c in united:
        items = inside.select("_to", F.explode(c).alias("_i")).distinct().groupBy("_to").agg(F.array_sort(F.collect_list("_i")).alias(f"_{c}"))
        taken = taken.join(items, "_to", "left")
    stay = target.where(F.col(key) == F.col("_to")).drop("_to").join(taken.withColumnRenamed("_to", key), key, "left")
    own = {c: F.when(F.col("_n").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) if c in longest else F.coalesce(f"_{c}", c) for c in [*longest, *filled, *united]}
    return stay.select(*[own[c].alias(c) if c in own else F.col(c) for c in rows.columns])


def renamed(rows: DataFrame, key: str, array: str, names: DataFrame) -> DataFrame:
    """Names (old, new) replaced in an array column, repeats dropped, order kept."""
    return repointed(rows, key, array, names)


def merge_everywhere(rows: DataFrame, key: str, members: DataFrame, score: str, arrays: dict[str, tuple[DataFrame, str, str]], references: dict[str, tuple[DataFrame, str]], vectors: dict[str, tuple[DataFrame, str]], **merge) -> dict[str, DataFrame]:
    """All tables after the classes (key, root) have merged: ``rows`` themselves; tables with arrays of keys (name: table, key, array) and with
    one key a row (name: table, column) follow, and vectors (name: table, key) of rows that went go. ``moved`` holds (old, new)."""
    moved = written(survivors(rows, key, members, F.col(score)))
    out = {"rows": merged_rows(rows, key, moved, score, **merge), "moved": moved}
    out |= {name: repointed(table, own, array, moved) for name, (table, own, array) in arrays.items()}
    out |= {name: repointed_rows(table, column, moved) for name, (table, column) in references.items()}
    gone = moved.select("old")
    return out | {name: table.join(gone, table[own] == gone["old"], "left_anti") for name, (table, own) in vectors.items()}


def dangling(rows: DataFrame, key: str, table: DataFrame, own: str, array: str) -> DataFrame:
    """(own, ref): references in an array that no row has."""
    return edges(table, own, array).join(rows.select(F.col(key).alias("ref")), "ref", "left_anti").select(own, "ref")
