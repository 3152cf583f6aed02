"""Lookups, paging and name matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nested import non_empty


def page(rows: DataFrame, key: str, sort: str | None = None, descending: bool = False, number: int = 1, size: int = 25, allowed: list[str] | None = None) -> DataFrame:
    """One page; a sort column that is not allowed falls back to the key, ascending. Nulls come first ascending."""
    known = allowed or rows.columns
    order = [F.col(key)] if sort not in known else [F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first(), F.col(key)]
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def by_ids(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows of the requested ids in request order (``pos``), repeats kept, missing ones left out."""
    wanted = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos int, {key} {rows.schema[key].dataType.simpleString()}")
    return rows.join(F.broadcast(wanted), key).orderBy("pos")


def containing(rows: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any column, whatever its case."""
    found = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False)) for c in rows.columns]
    cond = found[0]
    for f in found[1:]:
        cond = cond | f
    return rows.where(cond)


def equal_ci(rows: DataFrame, column: str, text: str) -> DataFrame:
    return rows.where(F.lower(column) == text.lower())


def tiered(rows: DataFrame, probes: DataFrame, probe: str, tiers: list, key: str) -> DataFrame:
    """The first row of the first tier that matches each probe.

    A tier is a pair of expressions ``(of the probe, of the row)`` joined by equality, so every tier is an equi-join.
    """
    found = None
    for i, (left, right) in enumerate(tiers, 1):
        hit = probes.withColumn("_k", left).join(rows.withColumn("_k", right), "_k").select(probe, F.lit(i).alias("tier"), key)
        found = hit if found is None else found.unionByName(hit)
    order = Window.partitionBy(probe).orderBy("tier", key)
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows, and rows whose JSON list column is neither null nor '' nor '[]'."""
    return rows.agg(F.count("*").alias("n"), F.count_if(non_empty(F.col(column))).alias("n_filled"))


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows in a seeded random order that does not depend on partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def last_per_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Of rows with one name the last wins."""
    others = [c for c in rows.columns if c != name]
    return rows.groupBy(name).agg(*[F.max_by(c, order).alias(c) for c in others])


def page_total(rows: DataFrame, size: int = 25) -> DataFrame:
    """One row (n, pages): how many rows and pages there are to browse."""
    return rows.agg(F.count("*").alias("n")).withColumn("pages", F.ceil(F.col("n") / size))
