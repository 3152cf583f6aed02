"""Review of a knowledge base: queues, file audits, reference counts, validity of entries, rows of staged documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import new_id
from .integrity import failures

# Names of image sizes that an entry may have.
IMAGE_SIZES = ["large", "large_rectangle", "larger", "medium", "small", "square", "tall"]
_OBJECT = "map<string,variant>"


def queue_counts(items: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """One row (total, processed, not_duplicate, remaining) of a queue; ``done`` has the key and its outcome."""
    outcomes = done.groupBy(key).agg(F.max(F.col("outcome") == "not_duplicate").alias("_kept"))
    joined = items.select(key).join(outcomes, key, "left")
    return joined.agg(
        F.count("*").alias("total"), F.count("_kept").alias("processed"), F.count_if("_kept").alias("not_duplicate"), F.count_if(F.col("_kept").isNull()).alias("remaining")
    )


def next_item(items: DataFrame, key: str, order: str, done: DataFrame) -> DataFrame:
    """The first item in order that no outcome names."""
    return items.join(done.select(key), key, "left_anti").orderBy(order, key).limit(1)


def audit(rows: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """(name, status) of every file name: missing (rows only), unused (files only), present; rows without one are left out."""
    wanted = rows.where(F.length(name) > 0).select(name).distinct().withColumn("_row", F.lit(True))
    there = files.select(name).distinct().withColumn("_file", F.lit(True))
    status = F.when(F.col("_file").isNull(), "missing").when(F.col("_row").isNull(), "unused").otherwise("present")
    return wanted.join(there, name, "full").select(name, status.alias("status"))


def reference_counts(owners: DataFrame, key: str, **references: DataFrame) -> DataFrame:
    """(key, a count for each named table of references); counts are combined before they meet the owners."""
    out = owners.select(key)
    for name, rows in references.items():
        out = out.join(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def linked_like(rows: DataFrame, others: DataFrame, key: str, column: str, text: str) -> DataFrame:
    """Rows with their partners of the same key whose column holds the text in any case."""
    return rows.where(F.col(column).ilike(f"%{text}%")).join(others, key)


def first_named(rows: DataFrame, names: DataFrame, name: str, key: str, kind: Column) -> DataFrame:
    """(name, key): the first row of a kind with exactly each name."""
    return rows.where(kind).join(names.select(name).distinct(), name).groupBy(name).agg(F.min(key).alias(key))


def entry_errors(rows: DataFrame, key: str, value: str, json_fields: list[str], existing: DataFrame, descriptions: str | None = None, urls: str | None = None, rights: str | None = None) -> DataFrame:
    """(key, errors) of entries before they are inserted; an entry without errors has an empty array.

    Checked are the key (given, not in ``existing``), the value, JSON fields, the form of descriptions (an object of
    objects with a description) and of image URLs (an object of known sizes, at least one), and rights.
    """
    known = existing.select(F.col(key)).distinct().withColumn("_there", F.lit(True))
    read = lambda c: F.try_parse_json(F.col(c))
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    rules = {
        "id_missing": F.length(F.col(key).cast("string")) > 0,
        "id_exists": F.col("_there").isNull(),
        "value_missing": given(value),
    }
    for c in json_fields:
        rules[f"invalid_json_{c}"] = ~given(c) | read(c).isNotNull()
    if descriptions:
        found = F.try_variant_get(read(descriptions), "$", _OBJECT)
        each = lambda test: F.coalesce(F.forall(F.map_values(found), test), F.lit(True))
        rules["descriptions_no_object"] = ~given(descriptions) | read(descriptions).isNull() | found.isNotNull()
        rules["description_no_object"] = each(lambda v: F.try_variant_get(v, "$", _OBJECT).isNotNull())
        rules["description_missing"] = each(lambda v: F.coalesce(F.map_contains_key(F.try_variant_get(v, "$", _OBJECT), F.lit("description")), F.lit(True)))
    if urls:
        sizes = F.map_keys(F.try_variant_get(read(urls), "$", _OBJECT))
        rules["urls_no_object"] = ~given(urls) | read(urls).isNull() | sizes.isNotNull()
        rules["size_unknown"] = F.coalesce(F.forall(sizes, lambda s: s.isin(IMAGE_SIZES)), F.lit(True))
        rules["urls_missing"] = given(urls) & (F.col(urls) != "{}")
    if rights:
        rules["rights_missing"] = given(rights)
    return rows.join(known, key, "left").select(key, failures(rules).alias("errors"))


def table_rows(staged: DataFrame, key: str, ids: list[str], defaults: dict[str, str], existing: DataFrame, removed: Column | None = None) -> DataFrame:
    """Staged documents as table rows: the first given id or a new one, columns with their defaults, and the action.

    Rows that a reviewer removed are left out. An update resets ``images`` where that is among the defaults' columns.
    """
    kept = staged if removed is None else staged.where(~F.coalesce(removed, F.lit(False)))
    made = new_id("", 24, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in staged.columns])
    kind = existing.schema[key].dataType
    chosen = F.coalesce(*[F.col(c).cast(kind) for c in ids], *([made] if kind.simpleString() == "string" else []))
    known = existing.select(F.col(key)).distinct().withColumn("_there", F.lit(True))
    columns = [F.lit("[]").alias(c) if c == "images" else F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in defaults.items()]
    return kept.select(chosen.alias(key), *columns).join(known, key, "left").withColumn("sql_action", F.when(F.col("_there"), "UPDATE").otherwise("INSERT")).drop("_there")


def export_counts(rows: DataFrame) -> DataFrame:
    """(sql_action, n) of table rows."""
    return rows.groupBy("sql_action").agg(F.count("*").alias("n"))
