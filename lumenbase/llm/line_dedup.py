"""Line dedup: lines that many documents share stay in one of them only.

Pass one reads the texts once and writes the 128-bit hashes of their line keys, with the doc_ids that one step found
each in. Two Bloom filters, of keys seen by one document and by a second, are built over that table; they are sized
from its approximate number of keys (see ``bloom``). Only suspected repeats are shuffled: their documents are counted
exactly, and the largest doc_id is chosen to keep the line. Pass two takes the lines out. Up to ``MOST_SHARED``
shared keys are broadcast (24 bytes each), so texts stay where they are; beyond that each document is joined with the
keys that it loses.

Defined results: null or empty text is one empty line and stays as empty text; a document is a doc_id, so repeated
rows count once, and rows that share the kept doc_id all keep the line; rows without a doc_id count as no document and
keep their lines; an empty table gives no rows; extra input columns pass through unchanged, except that ``n_lines``
and ``n_dropped`` of the input give way to the result's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import SCHEMA, filter_rows, merged, segments_for, suspected
from .common import BLANKS, documents, extended, named, positional, steps, written

LEAST_CHARS, LEAST_DOCS, MOST_SHARED = 40, 5, 1 << 20


def _key(line: str) -> bytes | None:
    stripped = line.strip(BLANKS)
    return stripped.encode().lower() if len(stripped) >= LEAST_CHARS else None  # bytes: only A-Z fold


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two longs for each key: shape (n, 2)."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, keys)), "<i8").reshape(-1, 2)


def line_keys(docs: DataFrame) -> DataFrame:
    """(h1, h2, ids): for each step of a task and each line key in it, the doc_ids that hold it."""

    def find(batches):
        for batch in steps(batches, "text"):
            held: dict[bytes, dict] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and len(text) >= LEAST_CHARS:
                    for line in text.split("\n"):
                        if key := _key(line):
                            held.setdefault(key, {})[doc_id] = None
            pair = _hashes(list(held))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(map(list, held.values()), pa.list_(pa.int64()))], ["h1", "h2", "ids"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(find, "h1 long, h2 long, ids array<long>")


def seen_twice(keys: DataFrame, segments: int) -> DataFrame:
    """Marks of the filter of keys that at least two documents may hold."""

    def build(batches):
        parts = [(np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)) > 1) for b in batches if b.num_rows]
        hashes, many = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, bool))
        once, counts = np.unique(hashes, return_counts=True)
        yield from filter_rows(once, np.concatenate([once[counts > 1], hashes[many]]), segments)

    return written(merged(keys.select("h1", F.expr("cast(size(ids) as long)").alias("n")).mapInArrow(build, SCHEMA), "twice", segments))


def shared_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, keeper) of the keys that LEAST_DOCS documents hold, and the suspected rows (h1, h2, ids)."""
    keys = written(line_keys(docs))
    segments = segments_for(keys.agg(F.approx_count_distinct("h1", 0.02)).first()[0])
    found = written(suspected(keys, "h1", seen_twice(keys, segments), segments))
    each = found.select("h1", "h2", F.explode("ids").alias("id")).distinct()
    shared = each.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(f"n >= {LEAST_DOCS}")
    return written(shared.select("h1", "h2", "keeper")), found


def _lose(docs: DataFrame, at: int, width: int, loses) -> DataFrame:
    """Text and counts after the lines go; ``loses`` takes a batch and a list of rows and keys, and says which go."""

    def apply(batches):
        for batch in steps(batches, f"c{at}"):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            wanted, rows, keys, places = loses.candidates(batch), [], [], []
            for i in wanted:
                if len(texts[i]) >= LEAST_CHARS:
                    for place, line in enumerate(texts[i].split("\n")):
                        if key := _key(line):
                            rows.append(i)
                            keys.append(key)
                            places.append(place)
            gone: dict[int, set] = {}
            if keys:
                for j in np.flatnonzero(loses(batch, np.array(rows), _hashes(keys))).tolist():
                    gone.setdefault(rows[j], set()).add(places[j])
            n_lines = [t.count("\n") + 1 for t in texts]
            for i, lost in gone.items():
                texts[i] = "\n".join([line for place, line in enumerate(texts[i].split("\n")) if place not in lost])
            columns = list(batch.columns[:width])
            columns[at] = pa.array(texts, pa.string())
            n_dropped = [len(gone.get(i, ())) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*(f"c{i}" for i in range(width)), "n_lines", "n_dropped"])

    return docs.mapInArrow(apply, extended(docs.select(*docs.columns[:width]), "n_lines long, n_dropped long"))


class _Broadcast:
    """All shared keys, sorted, with the doc_id that keeps each."""

    def __init__(self, shared, doc_id: int):
        self.shared, self.doc_id = shared, doc_id

    def candidates(self, batch):
        return np.flatnonzero(np.asarray(batch.column(self.doc_id).is_valid())).tolist() if len(self.shared.value[0]) else []

    def __call__(self, batch, rows, pairs):
        h1, h2, keeper = self.shared.value
        ids = np.asarray(batch.column(self.doc_id).fill_null(0)).astype(np.int64)[rows]
        gone = np.zeros(len(rows), bool)
        first, last = np.searchsorted(h1, pairs[:, 0], "left"), np.searchsorted(h1, pairs[:, 0], "right")
        while len(some := np.flatnonzero(first < last)):  # once, but for 64-bit collisions
            k = first[some]
            gone[some] |= (h2[k] == pairs[some, 1]) & (keeper[k] != ids[some])
            first[some] += 1
        return gone


class _Joined:
    """The keys that each row loses, in a list beside it."""

    def __init__(self, column: int):
        self.column = column

    def candidates(self, batch):
        return np.flatnonzero(np.asarray(batch.column(self.column).is_valid())).tolist()

    def __call__(self, batch, rows, pairs):
        lost = {i: {(e["h1"], e["h2"]) for e in batch.column(self.column)[i].as_py()} for i in set(rows.tolist())}
        return np.array([tuple(p) in lost[i] for i, p in zip(rows.tolist(), pairs.tolist())])


def cleaned(docs: DataFrame) -> DataFrame:
    """The input by position (c0, c1, ...) with shared lines taken out of its text, n_lines (before) and n_dropped."""
    names, df = docs.columns, positional(docs)
    at, doc_id = names.index("text"), names.index("doc_id")
    shared, found = shared_keys(df.select(F.col(f"c{doc_id}").cast("long").alias("doc_id"), F.col(f"c{at}").alias("text")))
    if shared.count() <= MOST_SHARED:
        table = shared.toArrow().sort_by("h1")
        held = docs.sparkSession.sparkContext.broadcast(tuple(np.asarray(table.column(c)).astype(np.int64) for c in ("h1", "h2", "keeper")))
        return _lose(df, at, len(names), _Broadcast(held, doc_id))
    lost = found.join(shared, ["h1", "h2"]).select("h1", "h2", "keeper", F.explode("ids").alias("loser")).where("loser <> keeper")
    lost = lost.groupBy("loser").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))  # at most the lines of one document
    joined = df.join(lost, df[f"c{doc_id}"] == lost["loser"], "left").select(*df.columns, "lost")
    return _lose(joined, at, len(names), _Joined(len(names)))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The input with shared lines taken out of ``text``, plus n_lines (before) and n_dropped."""
    return named(cleaned(docs), docs.columns, ("n_lines", "n_dropped"), ("n_lines", "n_dropped"))


def without_shared_lines(docs: DataFrame) -> DataFrame:
    """The input, all columns as they were, with shared lines taken out of ``text``."""
    return named(cleaned(docs), docs.columns, (), ())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE_SQL = {
    "op10_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.*, (s.key IS NOT NULL AND k.doc_id <> s.keeper) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
