"""Repairs applied in one pass, with what was fixed and skipped counted in that same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import nested as N


def fixed_json(rows: DataFrame, columns: dict[str, Column], name: str = "fixed_json") -> tuple[DataFrame, Observation]:
    """The rows with malformed JSON converted where that can be done, in these columns (name: whether it holds an array).

    The observation gives ``fixed_<column>`` and ``skipped_<column>`` once an action has run; it scans nothing of its own."""
    seen = Observation(name)
    out, counts = rows, []
    for c, is_array in columns.items():
        out = out.withColumn(f"_issue_{c}", N.json_issue(F.col(c), is_array))
        kind, converted = F.col(f"_issue_{c}.kind"), F.col(f"_issue_{c}.converted")
        counts += [F.count_if(converted.isNotNull()).alias(f"fixed_{c}"), F.count_if(kind.isNotNull() & converted.isNull()).alias(f"skipped_{c}")]
    out = out.observe(seen, *counts)
    return out.select(*[F.coalesce(F.col(f"_issue_{c}.converted"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]), seen


def corrected(rows: DataFrame, key: str, corrections: DataFrame, columns: list[str], name: str = "corrected") -> tuple[DataFrame, Observation]:
    """The rows with these columns replaced by those of ``corrections`` (key and columns); the observation counts rows ``fixed`` and ``same``,
    which a correction names but does not change. Corrections are a row a key; null corrects nothing."""
    seen = Observation(name)
    new = corrections.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, F.col(key) == F.col("_key"), "left")
    value = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    differs = F.coalesce(F.greatest(*[(~value[c].eqNullSafe(F.col(c))).cast("int") for c in columns], F.lit(0)), F.lit(0)) > 0
    joined = joined.withColumn("_fixed", differs).observe(seen, F.count_if("_fixed").alias("fixed"), F.count_if(F.col("_key").isNotNull() & ~F.col("_fixed")).alias("same"))
    return joined.select(*[value[c].alias(c) if c in value else F.col(c) for c in rows.columns]), seen


def fixed_urls(rows: DataFrame, urls: str, scheme: str = "https", name: str = "fixed_urls") -> tuple[DataFrame, Observation]:
    """The rows with entries of a map of URLs mended: surrounding blanks and empty entries go, a missing scheme is added, and what still has
    no host goes; the observation counts entries ``fixed`` and ``dropped``."""
    seen = Observation(name)
    whole = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"
    mend = lambda u: F.when(F.trim(u).rlike(whole), F.trim(u)).when(F.trim(u).rlike(r"^(//)?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+([/?#:]|$)"), F.concat(F.lit(f"{scheme}://"), F.regexp_replace(F.trim(u), "^//", "")))
    made = F.transform_values(F.col(urls), lambda k, u: mend(u))
    kept = F.map_filter(made, lambda k, u: u.isNotNull())
    changed = F.size(F.filter(F.map_entries(kept), lambda e: ~F.try_element_at(F.col(urls), e["key"]).eqNullSafe(e["value"])))
    lost = F.size(F.map_keys(F.col(urls))) - F.size(F.map_keys(kept))
    out = rows.withColumn("_kept", kept).withColumn("_changed", F.coalesce(changed, F.lit(0))).withColumn("_lost", F.coalesce(lost, F.lit(0)))
    out = out.observe(seen, F.sum("_changed").alias("fixed"), F.sum("_lost").alias("dropped"))
    return out.select(*[F.when(F.col(urls).isNotNull(), F.col("_kept")).alias(c) if c == urls else F.col(c) for c in rows.columns]), seen


def outcomes(rows: DataFrame, outcome: str) -> DataFrame:
    """(outcome, n) with a row of the total, outcome null: counters of a run."""
    return rows.rollup(outcome).agg(F.count("*").alias("n"), F.grouping(outcome).alias("_all")).where(F.col("_all").cast("boolean") | F.col(outcome).isNotNull()).drop("_all")
