"""Exact quantiles of groups of any size: a histogram says which bucket holds the rank, and only that bucket is looked at again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, written

#: Buckets of a group's histogram, and values of a bucket that are sorted in a group.
BUCKETS, MOST = 256, 10_000


def quantile_by(rows: DataFrame, group: str, value: str, share: float, buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """(group, quantile): the exact quantile with linear interpolation between the two values beside its rank; null values don't count.

    A round counts values by bucket, combined before the shuffle, and keeps the bucket of each of the two ranks; buckets that still hold more
    than ``most`` values, which are not all equal, are cut again. So no task holds a group's values, however many they are."""
    rows = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    spans = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = (F.col("n") - 1) * share
    wanted = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("i"), F.ceil(at).alias("rank"))))
    # rank: of the value looked for among those from low to high, from 0; n: how many these are
    state = written(spans.select("g", (at - F.floor(at)).alias("part"), "n", "low", "high", wanted.alias("w")).select("g", "part", "w.i", "w.rank", "n", "low", "high"))
    while not state.where(f"n > {most} and low < high").isEmpty():
        wide = state.where(f"n > {most} and low < high")
        inside = rows.join(wide.select("g", "i", "low", "high").withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).where("v between low and high")
        bucket = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets), F.lit(buckets - 1))
        counts = inside.groupBy("g", "i", bucket.alias("b")).agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        upto = Window.partitionBy("g", "i").orderBy("b")
        counts = counts.withColumn("before", F.sum("m").over(upto) - F.col("m"))
        found = wide.select(F.col("g").alias("_g"), F.col("i").alias("_i"), "part", "rank").join(counts, F.col("g").eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i")))
        found = found.where("rank >= before and rank < before + m").select("g", "part", "i", (F.col("rank") - F.col("before")).alias("rank"), F.col("m").alias("n"), F.col("least").alias("low"), F.col("greatest").alias("high"))
        old, state = state, written(state.where(f"not (n > {most} and low < high)").union(found))
        dropped(old)
    flat = state.where("low = high").select("g", "part", "i", F.col("low").alias("v"))
    few = state.where("low < high")
    inside = rows.join(few.select(F.col("g").alias("_g"), "part", "i", "rank", "low", "high"), F.col("g").eqNullSafe(F.col("_g"))).where("v between low and high")
    order = Window.partitionBy("g", "i").orderBy("v")
    picked = inside.withColumn("_r", F.row_number().over(order) - 1).where("_r = rank").select("g", "part", "i", "v")
    both = flat.union(picked).groupBy("g").agg(F.max("part").alias("part"), F.min_by("v", "i").alias("a"), F.max_by("v", "i").alias("b"))
    return both.select(F.col("g").alias(group), (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))
