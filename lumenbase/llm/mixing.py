"""Mixing sources to target weights, in DataFrame and SQL functions alone.

Word counts are summed by source. Sources in code point order, null last, get the weights in turn and share ``SHARE`` times
all words; a source's target stops at ``MOST`` times its own words, and what it leaves over is shared again by weight. That
ends at one level: a source of weight w gets ``min(MOST * words, w * level)``. With sources sorted by words over weight,
the level is the greatest of (what is to be shared - what the sources before can take) / (the weights from here on), so two
running sums over the sources find it and nothing is repeated until it settles. A source's rate is its target over its
words. Each document is emitted ``floor(rate)`` times and once more if its own draw, a hash of the seed and doc_id,
is below the fraction that is left; so the result is the same in each run, whatever the partitioning.

Only sums by source are shuffled, combined before the shuffle, so a source with a third of all rows costs nothing more. The
running sums are over one row a source. Spark broadcasts the sources to the documents where they are few; where they are
many it joins by a shuffle, in which it splits a crowded source.

Defined results: null and empty texts have no words, whatever their copies; a null source is a source; a source without words
has target and rate 0; rows that share a doc_id (null is one) share their draw, so repeated rows are taken alike; an empty
table gives no rows; other columns pass through, less those that the results name. A source of few documents can only come
as near its target as whole copies of them allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, named, positional, written

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 42
#: Hexadecimal digits of a draw: a double holds 52 bits exactly.
DIGITS = 13


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) of each source in ``sizes`` (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    taken, past = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in (most * F.col("source_size"), F.col("weight")))
    left = (share * F.sum("source_size").over(every) - taken) / (F.sum("weight").over(every) - past)
    levelled = weighed.withColumn("left", left).withColumn("level", F.max("left").over(every))
    target = F.least(most * F.col("source_size"), F.col("weight") * F.col("level"))
    return levelled.select("source", "source_size", target.alias("target")).withColumn("rate", F.expr("if(source_size = 0, 0D, target / source_size)"))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1, less than 1, that depends on the seed and the id alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**DIGITS))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The input (doc_id, source, size and others) with source_size, target, copies and taken: the words of all copies."""
    names, df = docs.columns, positional(docs)
    doc_id, source, size = (F.col(f"c{names.index(n)}") for n in ("doc_id", "source", "size"))
    table = targets(df.select(source.alias("source"), size.alias("size")), weights, share, most)
    table = written(table.select(F.col("source").alias("of"), "source_size", "target", "rate"))
    joined = df.join(table, source.eqNullSafe(F.col("of")))
    copies = F.floor("rate") + (draw(doc_id, seed) < F.col("rate") - F.floor("rate")).cast("long")
    own = ("source_size", "target", "copies", "taken")
    return named(joined.withColumn("copies", copies).withColumn("taken", size * F.col("copies")), names, own, own)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; all columns as they were."""
    names, df = docs.columns, positional(docs)
    text, copies = F.col(f"c{names.index('text')}"), F.expr("explode(array_repeat(0, cast(copies as int)))")
    keyed = df.select(F.struct(*df.columns).alias("row"), F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('source')}").alias("source"), n_words(text).alias("size"))
    return mixture(keyed, **options).select("row", copies.alias("copy")).select("row.*").toDF(*names)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sizes are counted once: the sums and the documents' rows come from the written table
    sizes = written(documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mixture(sizes).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op11_source_mix": op11_source_mix}
ORACLE_SQL = {
    "op11_source_mix": rf"""
WITH sizes AS (
    SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight
    FROM sizes GROUP BY source
), lefts AS (
    SELECT *, ({SHARE} * CAST(sum(source_size) OVER () AS DOUBLE) - {MOST} * CAST(coalesce(sum(source_size) OVER before, 0) AS DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS l FROM totals
    WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
    SELECT source, source_size, least({MOST} * source_size, weight * (SELECT max(l) FROM lefts)) AS target FROM lefts
), rates AS (
    SELECT source, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate FROM goals
), copied AS (
    SELECT doc_id, size, source_size, target, CAST(floor(rate) AS BIGINT)
         + CASE WHEN CAST(CAST('0x' || left(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), {DIGITS}) AS BIGINT) AS DOUBLE) / {16**DIGITS} < rate - floor(rate) THEN 1 ELSE 0 END AS copies
    FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied
"""
}
