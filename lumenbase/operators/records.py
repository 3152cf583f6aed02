"""Records as the pages and routes of a catalogue take them: names, descriptions, clippings, staged documents, exports, caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .integrity import failures

#: Keys of descriptions that are shown elsewhere.
HIDDEN = ("description", "date", "additional_information")


# Values


def iso(at: Column) -> Column:
    """A time as text to the millisecond, in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def version_id(canvas: Column, at: Column) -> Column:
    return F.concat_ws("-", canvas, at)


def names_of(text: Column) -> Column:
    """Names from text that is a JSON list, or else names with commas between; null and empty text has none."""
    parsed = F.from_json(text, "array<string>", {"allowSingleQuotes": "false"})
    is_list = F.coalesce(F.trim(text).startswith("["), F.lit(False)) & parsed.isNotNull()
    return F.when(is_list, F.filter(parsed, lambda n: n.isNotNull())).otherwise(F.filter(F.split(F.coalesce(text, F.lit("")), r",\s+"), lambda n: n != ""))


def dated(descriptions: Column) -> Column:
    """The date of the first description, in the map's order, that has one."""
    with_date = F.filter(F.map_values(descriptions), lambda d: F.try_element_at(d, F.lit("date")).isNotNull())
    return F.try_element_at(F.get(with_date, F.lit(0)), F.lit("date"))


def shown(descriptions: Column) -> Column:
    """Distinct (label, value) of all descriptions, less what is shown elsewhere; keys written as labels."""
    entries = F.flatten(F.transform(F.map_values(descriptions), F.map_entries))
    return F.array_distinct(F.transform(F.filter(entries, lambda e: ~e["key"].isin(*HIDDEN)), lambda e: F.struct(X.display_key(e["key"]).alias("label"), e["value"].alias("value"))))


def keyword(entry_id: Column, value: Column, aliases: Column, descriptions: Column) -> Column:
    """A keyword as a page takes it: the id, its name, the names of its aliases (a list of maps), all descriptions."""
    return F.struct(entry_id.alias("entryId"), value.alias("value"), F.filter(F.transform(aliases, lambda a: F.coalesce(F.try_element_at(a, F.lit("value")), F.try_element_at(a, F.lit("name")))), lambda a: a.isNotNull()).alias("aliases"), F.map_values(descriptions).alias("descriptions"))


# Arrays of records: staged artists by slug, clippings by id


def by_slug(items: Column, slug: Column | str) -> Column:
    """The first item (a struct with name) with this slug."""
    wanted = F.lit(slug) if isinstance(slug, str) else slug
    return F.get(F.filter(items, lambda i: X.slug(i["name"]) == wanted), F.lit(0))


def without_slug(items: Column, slug: Column | str) -> Column:
    wanted = F.lit(slug) if isinstance(slug, str) else slug
    return F.filter(items, lambda i: ~X.slug(i["name"]).eqNullSafe(wanted))


def with_slug(items: Column, item: Column) -> Column:
    """The items with those of the same slug replaced by ``item``."""
    return F.transform(items, lambda i: F.when(X.slug(i["name"]) == X.slug(item["name"]), item).otherwise(i))


def with_clipping(clippings: Column, clipping: Column) -> Column:
    """Clippings (structs) with one more, unless an equal one is there."""
    return F.when(F.exists(clippings, lambda c: F.to_json(c) == F.to_json(clipping)), clippings).otherwise(F.concat(clippings, F.array(clipping)))


def without_clipping(clippings: Column, clipping_id: Column) -> Column:
    return F.filter(clippings, lambda c: ~c["id"].eqNullSafe(clipping_id))


def of_type(clippings: Column, kind: Column | str) -> Column:
    """Clippings of the open tab."""
    wanted = F.lit(kind) if isinstance(kind, str) else kind
    return F.filter(clippings, lambda c: c["type"] == wanted)


# Joins


def first_match(rows: DataFrame, wanted: DataFrame, column: str, key: str) -> DataFrame:
    """The first row, by key, for each wanted value (column)."""
    found = rows.join(wanted.select(column).distinct(), column, "left_semi")
    others = [c for c in rows.columns if c not in (column, key)]
    return found.groupBy(column).agg(F.min(F.struct(key, *others)).alias("_r")).select(column, "_r.*").select(*rows.columns)


def artists_of(rows: DataFrame, key: str, names: str, entries: DataFrame) -> DataFrame:
    """(key, artists): each name with the first entry (entry_id, value) of that name whatever its case, in the order of the names."""
    first = entries.groupBy(F.lower("value").alias("_name")).agg(F.min("entry_id").alias("entryId"))
    each = rows.select(key, F.posexplode(names).alias("_at", "name")).withColumn("_name", F.lower("name")).join(first, "_name", "left")
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "name", "entryId"))), lambda e: F.struct(e["name"].alias("name"), e["entryId"].alias("entryId"))).alias("artists"))


def with_images(found: DataFrame, key: str, images: str, details: DataFrame, image_key: str, most: int = 3) -> DataFrame:
    """Rows with the details of their first ``most`` images that there are, in order."""
    each = found.select(key, F.posexplode(images).alias("_at", image_key)).join(details, image_key)
    ranked = each.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).where(F.col("_n") <= most)
    listed = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*details.columns).alias("image")))), lambda e: e["image"]).alias("image_details"))
    return found.join(listed, key, "left")


def merged_edges(merged: DataFrame) -> DataFrame:
    """Edges (source, target) from each of the nodes (node) that were merged to the node (into) that they became."""
    return merged.select(F.col("node").alias("source"), F.col("into").alias("target")).where("source <> target").distinct()


def region_members(points: DataFrame, region: str, key: str, most: int | None = None) -> DataFrame:
    """(region, pos, key): a region's points in order, one a row, optionally the first ``most``; ``pos`` from 0."""
    order = Window.partitionBy(region).orderBy(key)
    ranked = points.select(region, key).withColumn("pos", F.row_number().over(order) - 1)
    return (ranked if most is None else ranked.where(F.col("pos") < most)).select(region, "pos", key)


# Staged documents


def staging_summary(staged: DataFrame) -> DataFrame:
    """One row of totals for staged artists (is_existing, artworks: an array of structs with is_existing)."""
    fresh = F.size(F.filter("artworks", lambda a: ~F.coalesce(a["is_existing"], F.lit(False))))
    old = F.size(F.filter("artworks", lambda a: F.coalesce(a["is_existing"], F.lit(False))))
    has, total = F.coalesce("is_existing", F.lit(False)), lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0))
    return staged.agg(
        F.count("*").alias("artists"), F.count_if(~has).alias("new_artists"), F.count_if(has).alias("existing_artists"), total(fresh).cast("long").alias("new_artworks"), total(old).cast("long").alias("artworks_to_update"),
    )


def name_summary(names: DataFrame, processed: DataFrame) -> DataFrame:
    """(total, processed, invalid): names asked for, those that were processed, and the rest."""
    done = processed.select("name").distinct().withColumn("_done", F.lit(True))
    counts = names.join(done, "name", "left").agg(F.count("*").alias("total"), F.count("_done").alias("processed"))
    return counts.withColumn("invalid", F.col("total") - F.col("processed"))


def submission_errors(rows: DataFrame, key: str, json_fields: list[str], urls: list[str], files: DataFrame | None = None, filename: str = "filename") -> DataFrame:
    """(key, errors) before a form is sent: JSON that can't be read, URLs that are not http(s), files (filename) that are not there."""
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    rules = {f"invalid_json_{c}": ~given(c) | F.try_parse_json(F.col(c)).isNotNull() for c in json_fields}
    rules |= {f"invalid_url_{c}": ~given(c) | F.col(c).rlike(r"^https?://[^/?#\s]+") for c in urls}
    if files is not None:
        there = files.select(F.col("filename").alias("_file")).distinct()
        rows = rows.join(there, F.col(filename) == F.col("_file"), "left")
        rules["file_missing"] = ~given(filename) | F.col("_file").isNotNull()
    return rows.select(key, failures(rules).alias("errors"))


def keyword_chain(*lists: Column) -> Column:
    """The first list of keywords that is neither null nor empty; an empty one if there is none."""
    filled = [F.when(F.size(c) > 0, c) for c in lists]
    return F.coalesce(*filled, F.array().cast("array<string>"))


def reset_queue(queue: DataFrame, key: str, status: str, parted: DataFrame, forget: bool = False) -> tuple[DataFrame, DataFrame]:
    """A review queue with every item pending again, and the list of parted pairs, empty if it is to be forgotten."""
    return queue.withColumn(status, F.lit("pending")).dropDuplicates([key]), parted.where("false") if forget else parted


# Exports and caches


def exported(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object; text that is a JSON object or list stands as such, other text as text."""
    plain = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    columns = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        value = plain(c)
        if f.dataType.simpleString() == "string":
            looks = F.coalesce(F.trim(c).rlike(r"^(\{[\s\S]*\}|\[[\s\S]*\])$"), F.lit(False))
            value = F.when(looks & F.try_parse_json(c).isNotNull(), c).otherwise(value)
        columns.append(F.concat(F.lit(json.dumps(f.name) + ":"), F.coalesce(value, F.lit("null"))))
    return rows.select(F.concat(F.lit("{"), F.concat_ws(",", *columns), F.lit("}")).alias("value"))


def cached(spark: SparkSession, folder: str, parameters: dict, make: Callable[[], DataFrame], fresh: bool = False) -> tuple[DataFrame, bool]:
    """A table kept below ``folder`` under the hash of its parameters, and whether it was there; a broken write is no entry."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{key}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) and not fresh
    if not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), there


def remade(rows: DataFrame, store: str, remake: bool, key: str) -> None:
    """Rows into a store (parquet): all of them anew, or those whose key it lacks."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/_SUCCESS")
    if remake or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows.write.mode("overwrite").parquet(store)
    else:
        rows.join(spark.read.parquet(store).select(key), key, "left_anti").select(*rows.columns).write.mode("append").parquet(store)


def enriched(staged: DataFrame, entries: DataFrame, images: DataFrame) -> DataFrame:
    """Staged artists (existing_id, is_existing, artworks) with their row's name in ``entries`` (entry_id, value), how many ``images`` (image_id,
    artist_names) name it, and how many of their artworks are new. Names count as whole names, so no artist counts another's."""
    named = entries.select(F.col("entry_id").alias("existing_id"), F.col("value").alias("db_name"))
    counts = images.select("image_id", F.explode(F.array_distinct("artist_names")).alias("db_name")).groupBy("db_name").agg(F.count("*").alias("existing_artworks_count"))
    known = staged.withColumn("existing_id", F.when(F.col("is_existing"), F.col("existing_id"))).join(named, "existing_id", "left").join(counts, "db_name", "left")
    fresh = F.size(F.filter(F.coalesce("artworks", F.array().cast(staged.schema["artworks"].dataType)), lambda a: ~F.coalesce(a["is_existing"], F.lit(False))))
    return known.withColumn("existing_artworks_count", F.coalesce("existing_artworks_count", F.lit(0))).withColumn("new_artworks_count", fresh.cast("long"))
