"""Inserts, upserts and deletes as rewrites: plain tables have no MERGE, so each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .integrity import first_failure


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table and those rows whose key it lacks; of rows with one key the smallest counts."""
    others = [c for c in table.columns if c != key]
    fresh = rows.join(table.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(key, "_r.*")
    return table.unionByName(fresh.select(table.columns))


def guarded_insert(table: DataFrame, rows: DataFrame, key: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table and those absent rows that pass all rules, and (key, reason) of the others: the first rule that fails, or ``exists``."""
    known = table.select(F.col(key).alias("_known")).distinct()
    judged = rows.join(known, F.col(key) == F.col("_known"), "left").withColumn("_reason", F.coalesce(first_failure(rules), F.when(F.col("_known").isNotNull(), "exists")))
    return insert_absent(table, judged.where("_reason is null").select(*rows.columns), key), judged.where("_reason is not null").select(key, F.col("_reason").alias("reason"))


def clashes(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys of rows that cannot be inserted: the table has them, or they repeat."""
    return rows.join(table.select(key), key, "left_semi").select(key).union(rows.groupBy(key).count().where("count > 1").select(key)).distinct()


def upsert(table: DataFrame, rows: DataFrame, key: str, keep_null: bool = False) -> DataFrame:
    """Rows replace the table's rows of their key or are added. With ``keep_null`` a null keeps the old value."""
    old, new = table.alias("o"), rows.withColumn("_new", F.lit(True)).alias("n")
    columns = []
    for c in table.columns:
        if c == key:
            columns.append(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key))
        elif c not in rows.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        elif keep_null:
            columns.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def delete(table: DataFrame, keys: DataFrame, key: str, only: Column | None = None) -> DataFrame:
    """The table without the rows of these keys (of those that ``only`` holds for)."""
    if only is None:
        return table.join(keys.select(key), key, "left_anti")
    gone = table.where(only).join(keys.select(key), key, "left_semi").select(key)
    return table.join(gone, key, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, keys: DataFrame, key: str, owner: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Parents without these keys (if the owner condition holds), and children without parents that went."""
    gone = parents.join(keys.select(key), key, "left_semi")
    gone = (gone if owner is None else gone.where(owner)).select(key)
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def append_refs(rows: DataFrame, key: str, array: str, refs: DataFrame) -> DataFrame:
    """References (key, ref) appended to an array column where they are absent, in ascending order."""
    fresh = refs.groupBy(key).agg(F.array_sort(F.collect_set("ref")).alias("_refs"))
    old = F.coalesce(F.col(array), F.array().cast(rows.schema[array].dataType))
    return rows.join(fresh, key, "left").withColumn(array, F.when(F.col("_refs").isNull(), F.col(array)).otherwise(F.concat(old, F.array_except("_refs", old)))).drop("_refs")


def literal(value: Column) -> Column:
    """A value as it reads in a statement's preview."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def statement(table: str, key: str, columns: list[str], action: Column) -> Column:
    """Preview of the INSERT or UPDATE of a row; an UPDATE names its key last."""
    others = [c for c in columns if c != key]
    insert = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ("), F.concat_ws(", ", *[literal(F.col(c)) for c in columns]), F.lit(")"))
    sets = F.concat_ws(", ", *[F.concat(F.lit(f"{c} = "), literal(F.col(c))) for c in others])
    return F.when(action == "INSERT", insert).otherwise(F.concat(F.lit(f"UPDATE {table} SET "), sets, F.lit(f" WHERE {key} = "), literal(F.col(key))))
