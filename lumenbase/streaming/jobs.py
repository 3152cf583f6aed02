"""Streaming variants: resumable batches, incremental embedding, debounced autosave, version compaction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import api_log


def resume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Handle what has arrived since the last run, then stop; progress is the checkpoint's."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental(stream: DataFrame, store: str, embed: Callable[[DataFrame], DataFrame], key: str, checkpoint: str):
    """Embed rows of the stream that the store (parquet) does not have yet and append them."""

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(store).select(key), key, "left_anti")
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        embed(fresh).write.mode("append").parquet(store)

    return resume(stream, handle, checkpoint)


def autosaves(events: DataFrame, key: str, at: str, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(key, saved_at, n): one save for each burst of events, once nothing came for ``gap``."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.max(at).alias("saved_at"), F.count("*").alias("n")).select(key, "saved_at", "n")


def compaction(saves: DataFrame, key: str, at: str, content: str) -> DataFrame:
    """(key, version, saved_at, content): each save with the number of its version; a version ends when content
    changes. State is the last content and number of a key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, number = state.get if state.exists else (None, -1)
        rows = pd.concat(list(frames)).sort_values(at)
        out = []
        for when, value in zip(rows[at], rows[content]):
            if number < 0 or value != last:
                last, number = value, number + 1
            out.append((k[0], number, when, value))
        state.update((last, number))
        yield pd.DataFrame(out, columns=[key, "version", "saved_at", content])

    kind = saves.schema[key].dataType.simpleString()
    return saves.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, version int, saved_at timestamp, {content} string", f"{content} string, number int", "append", GroupStateTimeout.NoTimeout)


def interval_saves(events: DataFrame, key: str, content: str, every_ms: int = 60_000) -> DataFrame:
    """(key, content, n): the last content of each key, once in every interval of processing time in which it had events, with their number.

    State is the content not yet saved, the number of events since, and when the next save is due; a timer saves what no later event does."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held, n, due = state.get if state.exists else (None, 0, now + every_ms)
        for frame in frames:
            if len(frame):
                held, n = frame[content].iloc[-1], n + len(frame)
        if n and (state.hasTimedOut or now >= due):
            yield pd.DataFrame({key: [k[0]], content: [held], "n": [n]})
            held, n, due = None, 0, now + every_ms
        if n:
            state.update((held, n, due))
            state.setTimeoutDuration(max(1, due - now))
        elif state.exists:
            state.remove()

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {content} string, n long", f"{content} string, n long, due long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def api_calls(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """A stream of API log lines (value) parsed, with ``at`` as a time that a watermark follows."""
    parsed = api_log(stream)
    return parsed.withColumn("at", F.to_timestamp("at")).where("at is not null").withWatermark("at", late)


def calls_per_minute(calls: DataFrame) -> DataFrame:
    """(minute, method, n) of parsed calls, each minute once it can get no more."""
    return calls.groupBy(F.window("at", "1 minute").alias("w"), "method").agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "method", "n")
