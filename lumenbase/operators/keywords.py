"""Keyword annotation: n-grams, candidates, weighted interval scheduling, reconstruction."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieval import knn_join

#: Phrases that are broadcast to be counted.
MOST_PHRASES = 500_000


def ngrams(texts: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """(key, phrase, start, stop): lower-cased word n-grams, stop inclusive."""
    words = texts.select(key, tokens(F.lower(text)).alias("w"))
    n = F.expr("size(w)")
    spans = F.expr(f"flatten(transform(sequence(1, {most}), n -> case when size(w) < n then cast(array() as array<struct<start:int,stop:int>>) else transform(sequence(0, size(w) - n), i -> named_struct('start', i, 'stop', i + n - 1)) end))")
    rows = words.where(n > 0).select(key, "w", F.explode(spans).alias("s"))
    return rows.select(key, F.expr("array_join(slice(w, s.start + 1, s.stop - s.start + 1), ' ')").alias("phrase"), "s.start", "s.stop")


def counted(texts: DataFrame, text: str, phrases: DataFrame, most: int = 3, bound: int = MOST_PHRASES) -> DataFrame:
    """(phrase, n): how often texts say each of the phrases (phrase, of up to ``most`` words), of those they say at all.

    Up to ``bound`` distinct phrases are broadcast: a task looks them up in its texts and gives one count a phrase, so nothing else is
    listed or shuffled. More phrases are joined with the n-grams."""
    wanted = phrases.select("phrase").where("phrase is not null").distinct()
    if wanted.count() > bound:
        return ngrams(texts.withColumn("_key", F.lit(0)), "_key", text, most).select("phrase").join(wanted, "phrase", "left_semi").groupBy("phrase").agg(F.count("*").alias("n"))
    held = [r["phrase"] for r in wanted.collect()]
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(held))
    words = texts.select(tokens(F.lower(text)).alias("w"))

    def count(batches):
        known, found = shared.value, {}
        # the words that phrases begin with, with how many words these have
        sizes: dict[str, int] = {}
        for p in known:
            first, n = p.split(" ", 1)[0], p.count(" ") + 1
            sizes[first] = max(n, sizes.get(first, 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for w in batch.column(0).slice(at, 256).to_pylist():
                    for i, size in enumerate(map(sizes.get, w or [])):
                        if size:
                            for n in range(1, min(size, most, len(w) - i) + 1):
                                p = w[i] if n == 1 else " ".join(w[i : i + n])
                                if p in known:
                                    found[p] = found.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["phrase", "n"])

    return words.mapInArrow(count, "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("n"))


def candidates(grams: DataFrame, matches: DataFrame, entries: DataFrame | None, least: float) -> DataFrame:
    """N-grams with their nearest match (phrase, id, similarity) whose id exists (in ``entries``, if given) and whose similarity is enough.

    The nearest of a phrase is chosen once for each distinct phrase, before the join."""
    known = matches.where(F.col("similarity") >= least)
    if entries is not None:
        known = known.join(entries.select("id"), "id", "left_semi")
    best = known.groupBy("phrase").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("id"))).alias("b"))
    return grams.join(best.select("phrase", F.col("b.id").alias("id"), (-F.col("b.s")).alias("similarity")), "phrase")


def phrase_matches(phrases: DataFrame, entries: DataFrame, k: int, least: float) -> DataFrame:
    """(phrase, id, similarity): the k nearest entries (id, embedding) of each distinct phrase that are similar enough;
    what ``candidates`` takes. A phrase that many texts hold is looked up once."""
    near = knn_join(entries, phrases.dropDuplicates(["phrase"]), k, "id", "phrase")
    return near.select("phrase", "id", (1 - F.col("distance")).alias("similarity")).where(F.col("similarity") >= least)


def _schedule(spans: list[tuple[int, int, float, object]]) -> list[int]:
    """Indices of non-overlapping spans (start, stop, score, id) of the highest total; a tie keeps the earlier choice."""
    if not spans:
        return []
    ends: dict[int, list[int]] = {}
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0], spans[i][1])):
        ends.setdefault(spans[i][1], []).append(i)
    n = max(ends) + 1
    total, choice = [0.0] * (n + 1), [None] * (n + 1)
    for at in range(1, n + 1):
        total[at] = total[at - 1]
        for i in ends.get(at - 1, []):
            gained = total[spans[i][0]] + spans[i][2]
            if gained > total[at]:
                total[at], choice[at] = gained, i
    chosen, at = [], n
    while at > 0:
        if choice[at] is None:
            at -= 1
        else:
            chosen.append(choice[at])
            at = spans[choice[at]][0]
    return chosen[::-1]


def best_spans(found: DataFrame, key: str) -> DataFrame:
    """(key, start, stop, id, similarity): for each text the disjoint spans of the highest total similarity.

    One text's candidates (at most three a word) are a group, so groups are bounded by a text's length."""
    kind = found.schema[key].dataType.simpleString()
    ids = found.schema["id"].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        spans = list(zip(rows["start"].tolist(), rows["stop"].tolist(), rows["similarity"].tolist(), rows["id"].tolist()))
        return rows.iloc[_schedule(spans)][[key, "start", "stop", "id", "similarity"]]

    return found.select(key, "start", "stop", "id", "similarity").groupBy(key).applyInPandas(solve, f"{key} {kind}, start int, stop int, id {ids}, similarity double")


def annotated(texts: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """(key, pos, words, id): the text as entries, a chosen span as one entry in its own case, other words singly."""
    words = texts.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "word"))
    joined = words.join(spans.select(F.col(key).alias("_k"), "start", "stop", "id"), (F.col(key) == F.col("_k")) & F.col("pos").between(F.col("start"), F.col("stop")), "left")
    grouped = joined.groupBy(key, F.coalesce("start", "pos").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda e: e["word"]), " ").alias("words"), F.first("id", ignorenulls=True).alias("id"))
    return grouped


def merged_keywords(parts: list[DataFrame], key: str, below: float, cap: bool) -> DataFrame:
    """Keyword lists (key, keyword_id, distance) joined in order: the first place of each keyword, its last distance,
    those under ``below``; optionally the first 3 to 7."""
    union = None
    for i, p in enumerate(parts):
        p = p.select(key, "keyword_id", "distance", F.lit(i).alias("part"), "rank")
        union = p if union is None else union.unionByName(p)
    place = F.struct("part", "rank")
    each = union.groupBy(key, "keyword_id").agg(F.min(place).alias("place"), F.max_by("distance", place).alias("distance")).where(F.col("distance") < below)
    order = Window.partitionBy(key).orderBy("place", "keyword_id")
    ranked = each.select(key, "keyword_id", "distance", F.row_number().over(order).alias("rank"))
    return ranked.where("rank <= 7") if cap else ranked


def keyword_lists(searches: list[tuple[DataFrame, DataFrame, int, float | None]], allowed: DataFrame, key: str, below: float, cap: bool) -> DataFrame:
    """Keywords of each query from several searches in order, merged: (index, queries, k, limit on the distance or None).

    What is no allowed keyword goes after the top k, so a search may give fewer than k."""
    parts = []
    for index, queries, k, limit in searches:
        found = knn_join(index, queries, k, "keyword_id", key).join(allowed.select("keyword_id"), "keyword_id", "left_semi")
        parts.append(found if limit is None else found.where(F.col("distance") < limit))
    return merged_keywords(parts, key, below, cap)


def after_stored(stored: DataFrame, found: DataFrame, key: str, cap: bool) -> DataFrame:
    """(key, keyword_id, distance, rank): the keywords that a row has already (key, keyword_id, pos), in their order and without a distance,
    then those found for it (of ``merged_keywords``) that it does not have; optionally the first 3 to 7. Either side may lack a key."""
    have = stored.select(key, "keyword_id", F.lit(0).alias("_part"), F.col("pos").cast("long").alias("_at"), F.lit(None).cast("double").alias("distance"))
    more = found.select(key, "keyword_id", F.lit(1).alias("_part"), F.col("rank").cast("long").alias("_at"), "distance")
    # the first place of each keyword: what is stored comes before what is found, so neither side is computed twice
    each = have.unionByName(more).groupBy(key, "keyword_id").agg(F.min(F.struct("_part", "_at", "distance")).alias("_first"))
    order = Window.partitionBy(key).orderBy("_first._part", "_first._at", "keyword_id")
    ranked = each.select(key, "keyword_id", F.col("_first.distance").alias("distance"), F.row_number().over(order).alias("rank"))
    return ranked.where("rank <= 7") if cap else ranked


def inherited(works: DataFrame, lists: DataFrame, artist: str, work: str) -> DataFrame:
    """(work, keyword_id, pos): the keywords that works (work, artist) take over from their artists' lists, in the artists' order; of several
    artists the first that has a keyword gives its place."""
    joined = works.select(work, artist).join(lists.select(artist, "keyword_id", "rank"), artist)
    return joined.groupBy(work, "keyword_id").agg(F.min("rank").alias("pos"))


def search_parts(rows: DataFrame, key: str, details: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """(key, part, is_synonym): what is searched for a row besides its whole text: each comma-separated part of the values of a map, and for
    parts with synonyms, in lower case, these."""
    each = rows.select(key, F.explode(F.map_values(details)).alias("value")).select(key, F.explode(F.split("value", ",")).alias("part"))
    each = each.select(key, F.trim("part").alias("part")).where("part <> ''").distinct()
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = each.select(key, F.explode(F.try_element_at(table, F.lower("part"))).alias("part")).distinct()
    return each.withColumn("is_synonym", F.lit(False)).union(more.withColumn("is_synonym", F.lit(True)))
