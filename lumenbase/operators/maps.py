"""Similarity maps: 2-D layout, k-means, zones and their statistics."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantile_by
from .retrieval import minmax


def pca_layout(rows: DataFrame, key: str, vector: str, unit_box: bool = True) -> DataFrame:
    """(key, x, y): the first two principal components, scaled to [-1, 1]; signs fixed by the largest coordinate."""
    data = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(data)
    parts = model.pc.toArray()
    signs = [1.0 if parts[abs(parts[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    xy = vector_to_array("_p")
    points = model.transform(data).select(key, (xy[0] * signs[0]).alias("x"), (xy[1] * signs[1]).alias("y"))
    return minmax(points, ["x", "y"]) if unit_box else points


def kmeans(points: DataFrame, k: int, seed: int = 42, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Points (x, y, ...) with a cluster, and the centroids (cluster, cx, cy); k is at most the number of points."""
    k = min(k, points.count())
    data = points.withColumn("_v", array_to_vector(F.array("x", "y")))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v", predictionCol="cluster").fit(data)
    centres = [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())]
    return model.transform(data).drop("_v"), points.sparkSession.createDataFrame(centres, "cluster int, cx double, cy double")


def zones(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, cx, cy, radius, n): mean centre, and 1.2 times the 90th percentile of the distances to it."""
    centres = points.groupBy(cluster).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    d = points.join(centres, cluster).select(cluster, F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2).alias("d"))
    radii = quantile_by(d, cluster, "d", 0.9).select(cluster, (F.col("quantile") * 1.2).alias("radius"))
    return centres.join(radii, cluster).select(cluster, "cx", "cy", "radius", "n")


def local_positions(points: DataFrame, areas: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Points with their place in their zone's unit disc (lx, ly), pulled to its rim from outside."""
    scale = lambda c, centre: F.when(F.col("radius") > 0, (F.col(c) - F.col(centre)) / F.col("radius")).otherwise(0.0)
    out = points.join(areas, cluster).withColumn("lx", scale("x", "cx")).withColumn("ly", scale("y", "cy"))
    far = F.greatest(F.sqrt(F.col("lx") ** 2 + F.col("ly") ** 2), F.lit(1.0))
    return out.select(*points.columns, (F.col("lx") / far).alias("lx"), (F.col("ly") / far).alias("ly"))


def region_stats(points: DataFrame, region: str) -> DataFrame:
    """Number of regions, mean, most and fewest points of one, sizes in order."""
    sizes = points.groupBy(region).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("regions"), F.avg("n").alias("mean_points"), F.max("n").alias("most"), F.min("n").alias("fewest"), F.array_sort(F.collect_list("n")).alias("sizes"))


def adjacency_stats(regions: Column | int, pairs: DataFrame, paired: int) -> DataFrame:
    """Possible and actual adjacencies, their percentage, unpaired regions, and the boundary lengths' range."""
    k = F.lit(regions) if isinstance(regions, int) else regions
    possible = (k * (k - 1) / 2).cast("long")
    return pairs.agg(
        F.first(possible).alias("possible"), F.count("*").alias("actual"), F.round(F.lit(100.0) * F.count("*") / F.first(possible), 1).alias("percentage"),
        F.first(k - 2 * F.lit(paired)).alias("unpaired"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.avg("length").alias("mean_length"),
    )


def complete_coordinates(document: DataFrame) -> DataFrame:
    """The points (id, x, y) of a map document, or none if any lacks a coordinate."""
    bad = document.agg((F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0).alias("_ok"))
    return document.join(F.broadcast(bad)).where("_ok").drop("_ok")


def merge_stats(regions: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """One row (original, merged, pairs, unmerged) for regions and the disjoint pairs (a, b) that merge."""
    paired = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct().withColumn("_paired", F.lit(True))
    n = regions.select(key).join(paired, key, "left").agg(F.count("*").alias("original"), F.count("_paired").alias("_in"))
    half = (F.col("_in") / 2).cast("long")
    return n.select("original", (F.col("original") - half).alias("merged"), half.alias("pairs"), (F.col("original") - F.col("_in")).alias("unmerged"))


def cache_key(names: Column) -> Column:
    """The first 8 hexadecimal digits of the MD5 of the sorted JSON list."""
    return F.substring(F.md5(F.to_json(F.array_sort(names))), 1, 8)


def map_points(points: DataFrame, entries: DataFrame, key: str, columns: list[str], artists: DataFrame) -> DataFrame:
    """Points (key, x, y) as a map's page takes them: entryId, x, y, artworkData (the entry's columns) and artistData (entries of names and ids,
    of ``records.artists_of``); points without an entry are left out, entries without an artist have none."""
    data = F.struct(key, *columns).alias("artworkData")
    joined = points.select(key, "x", "y").join(entries.select(key, *columns), key).join(artists.select(key, "artists"), key, "left")
    none = F.array().cast(artists.schema["artists"].dataType)
    return joined.select(F.col(key).alias("entryId"), "x", "y", data, F.struct(F.coalesce("artists", none).alias("entries")).alias("artistData"))


def region_rows(cells: DataFrame, points: DataFrame, region: str, label: Column | None = None) -> DataFrame:
    """Cells (region, vertices) as a map's page takes them: id, label ('Region n' from 1 where none is given), vertices, the mean of these as centroid,
    how many points are in it, clipped (false where cells have no such column). Ids of points come a row each from ``records.region_members``."""
    counts = points.groupBy(F.col(region).alias("region")).agg(F.count("*").alias("pointCount"))
    default = F.concat(F.lit("Region "), (F.col("region") + 1).cast("string"))
    mean = lambda c: F.aggregate("vertices", F.lit(0.0), lambda a, v: a + v[c]) / F.greatest(F.size("vertices"), F.lit(1))
    clipped = F.coalesce("clipped", F.lit(False)) if "clipped" in cells.columns else F.lit(False)
    return cells.join(counts, "region", "left").select(
        F.col("region").alias("id"), (default if label is None else F.coalesce(label, default)).alias("label"), "vertices", F.struct(mean("x").alias("x"), mean("y").alias("y")).alias("centroid"),
        F.coalesce("pointCount", F.lit(0)).cast("long").alias("pointCount"), clipped.alias("clipped"),
    )
