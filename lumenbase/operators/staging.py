"""Staged documents: validity rules, matching with existing rows, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Words of titles and names that are refused.
SPAM = ["gmail", "airbnb", "onlyfans", "paypal", "sell", "buy", "accounts", "skype", "verified", "hosting ready", "linkedin", "business", "zillow", "soundcloud", "binance", "coinbase", "instant access"]
NAME_PREFIXES = ["artist:", "painter:", "sculptor:"]
NO_NAMES = ["unknown", "anonymous", "various", "multiple", "school of", "after ", "attributed to", "circle of", "follower of", "workshop of", "studio of", "copy after"]
OPEN_RIGHTS = ["public", "commons", "cc", "domain", "open"]


def any_of(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(_quoted(w) for w in words))


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)


def good_title(title: Column) -> Column:
    return F.length(F.trim(title)).between(2, 60) & ~any_of(title, SPAM)


def open_rights(rights: Column) -> Column:
    return any_of(rights, OPEN_RIGHTS)


def artist_name(name: Column) -> Column:
    """The name without prefixes; null if it is none."""
    out = F.trim(name)
    for prefix in NAME_PREFIXES:
        out = F.trim(F.regexp_replace(out, f"(?i)^{prefix}", ""))
    good = (F.length(out) >= 2) & ~out.rlike(r"^\d+$") & ~any_of(out, NO_NAMES)
    return F.when(good, out)


def artwork_rules(title: Column, details: Column, rights: Column) -> dict[str, Column]:
    """Rules in the order in which the first failure is named; details is a map."""
    get = lambda k: F.try_element_at(details, F.lit(k))
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    place = F.coalesce(get("location"), get("collecting_institution"), F.lit(""))
    return {
        "title_length": F.length(title) <= 60,
        "date": filled(get("date")),
        "date_length": F.length(get("date")) <= 60,
        "rights": filled(rights),
        "metadata": filled(get("medium")) | filled(get("style")) | filled(get("genre")) | filled(get("movement")),
        "location_length": F.length(place) <= 60,
    }


def matched(rows: DataFrame, key: str, title: str, artist: str, existing: DataFrame, existing_key: str) -> DataFrame:
    """(key, existing_key, tier): the existing row of the same artist whose title agrees, by the first tier that hits:
    normalised, lower case, letters and digits only. Each tier is an equi-join with the first existing key of each title, so equal
    titles are not paired with each other."""
    tiers = [X.fold, lambda c: F.lower(c), lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")]
    found = None
    for i, f in enumerate(tiers, 1):
        a = rows.select(key, F.lower(artist).alias("_a"), f(F.col(title)).alias("_t"))
        b = existing.groupBy(F.lower(artist).alias("_a"), f(F.col(title)).alias("_t")).agg(F.min(existing_key).alias(existing_key))
        hit = a.join(b, ["_a", "_t"]).select(key, existing_key, F.lit(i).alias("tier"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(key).agg(F.min(F.struct("tier", existing_key)).alias("b"))
    return best.select(key, f"b.{existing_key}", "b.tier")


def compared(staged: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, status): new (staged only), update (both), db (existing only)."""
    a, b = staged.select(key).distinct().withColumn("_s", F.lit(1)), existing.select(key).distinct().withColumn("_e", F.lit(1))
    status = F.when(F.col("_e").isNull(), "new").when(F.col("_s").isNull(), "db").otherwise("update")
    return a.join(b, key, "full").select(key, status.alias("status"))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def progress(log: DataFrame) -> DataFrame:
    """(outcome, n) of a progress log: SUCCESS, SKIPPED, else OTHER."""
    outcome = F.when(F.col("status").isin("SUCCESS", "SKIPPED"), F.col("status")).otherwise("OTHER")
    return log.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def under_limit(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first ``most`` operations of each run, as a running count."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def thumbnails(sizes: Column) -> Column:
    """small, medium (of three or more) and large of an array of (width, height, url), by area."""
    order = F.array_sort(F.transform(sizes, lambda s: F.struct((s["width"] * s["height"]).alias("area"), s["url"].alias("url"))))
    n = F.size(order)
    at = lambda i: F.get(order, i)["url"]
    return F.struct(at(F.lit(0)).alias("small"), F.when(n >= 3, at(F.floor(n / 2).cast("int"))).alias("medium"), F.when(n >= 2, at(n - 1)).alias("large"))
