"""Referential integrity, duplicates and repairs over exploded id arrays (an edge table) and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

#: Rows of a task that sorts or counts them, pairs compared in a task, rows of a part of a group whose rows are paired, groups whose sizes are broadcast.
ROWS, PAIRS, PART, GROUPS = 1_000_000, 20_000_000, 1024, 50_000


def edges(rows: DataFrame, key: str, array: str) -> DataFrame:
    """(key, pos, ref): one row for each reference."""
    return rows.select(F.col(key), F.posexplode(array).alias("pos", "ref"))


def checked_refs(refs: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """References, one a row, with ``found``: whether their target exists. No array spans the references of a key."""
    known = targets.select(F.col(target).alias(ref)).distinct().withColumn("found", F.lit(True))
    return refs.join(known, ref, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def orphan_counts(checked: DataFrame, key: str) -> DataFrame:
    """(key, n_refs, n_missing) of the keys with a missing target; counts are combined before the shuffle."""
    return checked.groupBy(key).agg(F.count("*").alias("n_refs"), F.count_if(~F.col("found")).alias("n_missing")).where("n_missing > 0")


def orphans(rows: DataFrame, key: str, array: str, targets: DataFrame, target: str) -> DataFrame:
    """(key, valid, missing, n_refs): references split by whether their target exists, in order."""
    known = targets.select(F.col(target).alias("ref")).distinct().withColumn("found", F.lit(True))
    joined = edges(rows, key, array).join(known, "ref", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def those(found: bool) -> Column:
        kept = F.collect_list(F.when(F.col("found") == found, F.struct("pos", "ref")))
        return F.transform(F.array_sort(kept), lambda e: e["ref"])

    return joined.groupBy(key).agg(those(True).alias("valid"), those(False).alias("missing"), F.count("*").alias("n_refs")).where(F.size("missing") > 0)


def link_issues(artists: DataFrame, images: DataFrame) -> DataFrame:
    """(entry_id, image_id, issue) for artist rows (entry_id, value, images) and image rows (image_id, artist_names,
    related_ids), all typed; a null array is malformed. A link may have two issues."""
    bad = artists.where("images is null").select("entry_id", F.lit(None).cast("string").alias("image_id"), F.lit("malformed_json").alias("issue"))
    links = artists.select("entry_id", "value", F.explode("images").alias("image_id"))
    joined = links.join(images.withColumn("_found", F.lit(True)), "image_id", "left")
    issues = F.when(F.col("_found").isNull(), F.array(F.lit("missing_image"))).otherwise(
        F.array_compact(
            F.array(
                F.when(~F.coalesce(F.array_contains("artist_names", F.col("value")), F.lit(False)), F.lit("missing_artist_name")),
                F.when(~F.coalesce(F.array_contains("related_ids", F.col("entry_id")), F.lit(False)), F.lit("missing_related_keyword")),
            )
        )
    )
    return joined.select("entry_id", "image_id", F.explode(issues).alias("issue")).unionByName(bad)


def reconciled(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Keyword ids and labels brought in line.

    rows: entry_id, ids, labels (arrays); entries: id, label. Corrected ids are the valid ids and the ids of valid
    labels; corrected labels are the labels of valid ids and the valid labels. Of equal labels the last id counts.
    """
    known = entries.select(F.col("id").alias("ref"), F.col("label").alias("its_label"))
    by_label = entries.groupBy(F.col("label").alias("ref")).agg(F.max("id").alias("its_id"))
    ids = rows.select("entry_id", F.explode("ids").alias("ref")).join(known, "ref", "left")
    labels = rows.select("entry_id", F.explode("labels").alias("ref")).join(by_label, "ref", "left")
    a = ids.groupBy("entry_id").agg(
        F.collect_set(F.when(F.col("its_label").isNotNull(), F.col("ref"))).alias("good_ids"),
        F.collect_set(F.when(F.col("its_label").isNull(), F.col("ref"))).alias("bad_ids"),
        F.collect_set("its_label").alias("id_labels"),
    )
    b = labels.groupBy("entry_id").agg(
        F.collect_set(F.when(F.col("its_id").isNotNull(), F.col("ref"))).alias("good_labels"),
        F.collect_set(F.when(F.col("its_id").isNull(), F.col("ref"))).alias("bad_labels"),
        F.collect_set("its_id").alias("label_ids"),
    )
    none = F.array().cast("array<string>")
    j = rows.join(a, "entry_id", "left").join(b, "entry_id", "left")
    c = {n: F.coalesce(F.col(n), none) for n in ("good_ids", "bad_ids", "id_labels", "good_labels", "bad_labels", "label_ids")}
    out = j.select(
        "entry_id", "ids", "labels",
        F.array_sort(F.array_union(c["good_ids"], c["label_ids"])).alias("new_ids"),
        F.array_sort(F.array_union(c["id_labels"], c["good_labels"])).alias("new_labels"),
        F.array_sort(c["bad_ids"]).alias("invalid_ids"),
        F.array_sort(c["bad_labels"]).alias("invalid_labels"),
    )
    differs = lambda new, old: F.col(new) != F.array_sort(F.array_distinct(F.coalesce(F.col(old), none)))
    issue = (F.size("invalid_ids") > 0) | (F.size("invalid_labels") > 0) | differs("new_ids", "ids") | differs("new_labels", "labels")
    return out.withColumn("issue", issue)


def holders(wanted: DataFrame, key: str, rows: DataFrame, row_key: str, array: str) -> DataFrame:
    """(key, found): for each wanted id the rows whose array holds it, by joining the edge table."""
    found = edges(rows, row_key, array).join(wanted.select(F.col(key).alias("ref")), "ref").select(F.col("ref").alias(key), row_key).distinct()
    return found.groupBy(key).agg(F.array_sort(F.collect_list(row_key)).alias("found"))


def holder_rows(wanted: DataFrame, key: str, refs: DataFrame, row_key: str, ref: str) -> DataFrame:
    """(key, row_key): for each wanted id the rows that refer to it, one a row, given references (row_key, ref) as rows; no list is gathered."""
    rows = dealt(refs.select(F.col(ref).alias(key), row_key), refs.count(), ROWS, key)
    return rows.join(wanted.select(key).distinct(), key, "left_semi").distinct()


def holder_counts(held: DataFrame, key: str, row_key: str, first: int, rows: int | None = None) -> DataFrame:
    """(key, n, first): how many rows hold each id, and the first few. A task keeps a few of an id's rows before these meet; ``rows``
    is about how many there are, if known."""
    rows = held.count() if rows is None else rows
    parted = dealt(held.withColumn("_s", F.pmod(F.xxhash64(row_key), F.lit(64))), rows, ROWS, key, "_s")
    ranked = parted.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_s").orderBy(row_key)))
    few = [F.min(F.when(F.col("_r") == i, F.col(row_key))).alias(f"_{i}") for i in range(1, first + 1)]
    part = ranked.groupBy(key, "_s").agg(F.count("*").alias("n"), *few).select(key, "n", F.array_compact(F.array(*[f"_{i}" for i in range(1, first + 1)])).alias("few"))
    listed = F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, first)  # at most 64 times as many
    return dealt(part, rows, ROWS, key).groupBy(key).agg(F.sum("n").alias("n"), listed.alias("first"))


def recovered(artists: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artists (entry_id, images) without images: those that images (image_id, related_ids) point back to, with the
    images recovered, and the ids to delete."""
    bare = artists.where("images is null or size(images) = 0")
    found = holders(bare, "entry_id", images, "image_id", "related_ids")
    return found.withColumnRenamed("found", "images"), bare.select("entry_id").join(found, "entry_id", "left_anti")


def url_issues(rows: DataFrame, key: str, urls: str, status: DataFrame | None = None) -> DataFrame:
    """(key, size, issue) of entries in a map of URLs; a null map is not_dict; ``status`` has url and code, and the key where each row's
    URLs were asked for by themselves. Of several codes of one URL the highest counts."""
    bad = rows.where(F.col(urls).isNull()).select(key, F.lit(None).cast("string").alias("size"), F.lit("not_dict").alias("issue"))
    each = rows.select(key, F.explode(urls).alias("size", "url"))
    if status is not None:
        by = ["url", key] if key in status.columns else ["url"]
        each = each.join(status.groupBy(*by).agg(F.max("code").alias("code")), by, "left")
    code = F.col("code") if status is not None else F.lit(None).cast("int")
    issue = (
        F.when(F.col("url").isNull() | (F.trim("url") == ""), "empty")
        .when(~F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), "missing_scheme_or_host")
        .when(code.isNotNull() & (code != 200), F.concat(F.lit("status_"), code.cast("string")))
    )
    return each.select(key, "size", issue.alias("issue")).where("issue is not null").unionByName(bad)


def paired(rows: DataFrame, by: list[str], key: str) -> tuple[DataFrame, DataFrame, float]:
    """Two sides of the join of ``rows`` with themselves on ``by`` and ``_part``, and how many pairs it compares.

    A group of more than ``PART`` rows is cut: on the left a row is in one part of its group, on the right in each. Tasks grow in
    number with the pairs, so neither a large group nor many pairs of few rows are one task's."""
    rows = rows.dropna(subset=by)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    groups, n, pairs = (v or 0.0 for v in sizes.agg(F.count("*"), F.sum("_n"), F.sum(F.col("_n").cast("double") * F.col("_n"))).first())
    parts = sizes.select(*by, F.ceil(F.col("_n") / PART).alias("_parts"))
    known = rows.join(F.broadcast(parts) if groups <= GROUPS else parts, by)
    left = known.withColumn("_part", F.pmod(F.xxhash64(key), "_parts")).drop("_parts")
    right = known.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    tasks = n / ROWS + pairs / PAIRS
    return dealt(left, tasks, 1, *by, "_part"), dealt(right, tasks, 1, *by, "_part"), pairs


def name_pairs(rows: DataFrame, key: str, name: str, within: list[str] | None = None) -> DataFrame:
    """(a, b, name_key): rows with one name whatever its case, a < b, found by joining on the name.

    Pairs are the review queue; ``name_groups`` gives the same classes in one row each where they are large.
    """
    within = within or []
    keyed = rows.select(*within, F.col(key).alias("a"), F.lower(name).alias("name_key"))
    left, right, _ = paired(keyed, [*within, "name_key"], "a")
    return left.join(right.withColumnRenamed("a", "b"), [*within, "name_key", "_part"]).where("a < b").select(*within, "a", "b", "name_key")


def groups(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Groups of more than one row: their count and smallest key."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def unlisted_pairs(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(a, b): all ordered pairs of items that a reviewer left in one group, to be remembered as no duplicates."""
    items = dealt(rows.select(group, F.col(key).alias("a")), rows.count(), ROWS, group)
    left, right, pairs = paired(items, [group], "a")
    found = left.join(right.withColumnRenamed("a", "b"), [group, "_part"]).where("a < b").select("a", "b")
    return dealt(found, pairs / 2, ROWS, "a", "b").distinct()


def without_pairs(items: DataFrame, key: str, pairs: DataFrame, group: str) -> DataFrame:
    """Items that form no listed pair (a, b) with another item of their group."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = items.select(F.col(group).alias("_g"), F.col(key).alias("b"))
    barred = items.join(both, items[key] == both["a"]).join(other, "b").where(F.col("_g") == F.col(group)).select(items[key])
    return items.join(barred.distinct(), key, "left_anti")


def completeness(title: Column, descriptions: Column, urls: Column, date: Column, text: Column, keywords: Column) -> Column:
    """Score of a row: title 2, descriptions 3, urls 2, date 1, text 3, one a keyword, a hundredth a title letter."""
    has = lambda c, n: F.when(c, F.lit(float(n))).otherwise(F.lit(0.0))
    return (
        has(F.length(title) > 0, 2) + has(F.size(descriptions) > 0, 3) + has(F.size(urls) > 0, 2) + has(F.length(date) > 0, 1)
        + has(F.length(text) > 0, 3) + F.greatest(F.size(keywords), F.lit(0)) + 0.01 * F.coalesce(F.length(title), F.lit(0))
    )


def merge_groups(rows: DataFrame, group: str, key: str, score: str, longest: list[str], filled: list[str]) -> DataFrame:
    """One row a group: the key of the best score (first key on ties), the longest of some columns, the first filled
    of others in that order, and the keys that go. A group's keys are gathered, not its rows."""
    order = Window.partitionBy(group).orderBy(F.desc(score), F.col(key))
    ranked = rows.withColumn("_rank", F.row_number().over(order))
    text = [F.max_by(c, F.struct(F.coalesce(F.length(c), F.lit(-1)), -F.col("_rank"))).alias(c) for c in longest]
    fill = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in filled]
    gone = F.array_sort(F.collect_list(F.when(F.col("_rank") > 1, F.col(key)))).alias("merged_keys")
    return ranked.groupBy(group).agg(F.min_by(key, "_rank").alias(key), *text, *fill, gone)


def replacements(rows: DataFrame, by: list[str], key: str, score: Column) -> DataFrame:
    """(old, new): the rows of groups with several, and the row that a merge keeps: the best score, the first key on
    ties. The kept key is a combined aggregate, so a group's rows meet by a join and never in one task's memory."""
    keyed = rows.select(*by, F.col(key).alias("old"), score.alias("_score"))
    kept = keyed.groupBy(*by).agg(F.count("*").alias("_n"), F.min(F.struct((-F.col("_score")).alias("s"), F.col("old").alias("new"))).alias("_best")).where("_n > 1")
    return keyed.join(kept, by).where(F.col("old") != F.col("_best.new")).select("old", F.col("_best.new").alias("new"))


def repointed_rows(rows: DataFrame, ref: str, moved: DataFrame) -> DataFrame:
    """References, one a row, that follow merged rows (old -> new)."""
    return rows.join(moved, rows[ref] == moved["old"], "left").withColumn(ref, F.coalesce("new", F.col(ref))).drop("old", "new")


def repointed(rows: DataFrame, key: str, array: str, moved: DataFrame) -> DataFrame:
    """References (old -> new) replaced in an array column, repeats dropped, order kept."""
    e = edges(rows, key, array).join(moved.select(F.col("old").alias("ref"), "new"), "ref", "left")
    fixed = e.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "ref").alias("ref")))), lambda x: x["ref"])).alias("_fixed"))
    return rows.join(fixed, key, "left").withColumn(array, F.coalesce("_fixed", array)).drop("_fixed")


def failures(rules: dict[str, Column]) -> Column:
    """The names of the rules that are false or null."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def first_failure(rules: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
