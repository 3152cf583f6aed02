"""Substring dedup: a log-structured index of window fingerprints for incremental removal of repeated passages.

A window is ``WINDOW`` consecutive words. Each window is represented by the least hash of the 25-word grams inside it
(equal windows have equal ones, neighbouring windows mostly share theirs, so about one hash in 13 windows is indexed).
The index is a folder of immutable runs: tables of (gram, doc_id), bucketed and sorted by gram, one for each batch of
documents. ``add`` merge-joins a new batch's run with the runs of history, which are neither shuffled nor sorted
again. Grams that two documents hold are suspects; a Bloom filter sized from their number picks the windows to verify,
in the batch and in those historical texts alone that the runs name for a suspected gram; where these are few (``MOST_NAMED``)
their doc_ids are broadcast, so no other historical text leaves the scan. Windows are verified by two
64-bit hashes over independent word hashes: each task first settles what it can see itself, and only each window's
first holder in a task is shuffled. Two runs of equal level are compacted into one of the next when a later batch
comes, which then joins the merged run. The list of runs is committed last, so a broken ``add`` leaves the index as it
was, and a later session that opens the folder goes on from there. What an earlier batch has been given stays: a document of
a later batch loses what any historical document holds, whatever their doc_ids, and in a batch the smaller doc_id keeps.

Whole copies are settled first: a document whose text an earlier one holds loses every window and needs no entry, so
the index keeps a second table a run of (text hashes, first doc_id), bucketed and merge-joined alike. Up to
``MOST_COPIES`` marks of later copies are broadcast for the passes to skip; beyond that bound copies go through the
passes like other documents, with the same result.

Defined results: null, empty and short texts hold no window and lose nothing; repeated rows that share a doc_id do
not erase each other; rows without a doc_id neither give nor lose windows; an empty table gives no rows; extra input
columns pass through, except that ``n_words``, ``n_removed`` and ``kept_text`` give way to the result's.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import SCHEMA, Filter, filter_rows, merged, segments_for, small
from .common import documents, extended, file_system, named, positional, ragged, removed, scratch, steps, written

WINDOW, GRAM = 50, 25
#: Copies whose 64-bit marks are broadcast (32 MB), documents whose lost stretches are broadcast to their texts, and
#: the stretch that stands for all windows of a document.
MOST_COPIES, MOST_LOSERS, ALL = 4_000_000, 500_000, -1
#: Historical documents whose doc_ids are broadcast (16 MB); beyond, a Bloom filter of them picks.
MOST_NAMED = 1_000_000
#: Bytes of text that a task splits into words at a time.
STEP = 1 << 20
#: Odd multipliers of the two polynomial hashes, and of the final mixing.
BASES, MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class _Rolling:
    """Polynomial hashes of all stretches of a given length, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))

    def __call__(self, words: np.ndarray, *lengths: int) -> list[np.ndarray]:
        n = len(words)
        if not n:
            return [words for _ in lengths]
        power = np.cumprod(np.full(n, self.base, np.uint64))
        back = np.cumprod(np.full(n, self.inverse, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)])
        out = []
        for k in lengths:
            x = (sums[k:] - sums[:-k]) * back[: max(0, n - k + 1)] if n >= k else words[:0]
            x = (x ^ (x >> np.uint64(32))) * MIX
            out.append(x ^ (x >> np.uint64(29)))
        return out


_rolling = [_Rolling(b) for b in BASES]


def _word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word, shape (2, n), and the words of each text."""
    import xxhash

    split = [t.split() if t else [] for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(w) for words in split for w in words]), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both.T), counts


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in the row and position in the joined array of every window."""
    n = np.maximum(counts - (WINDOW - 1), 0)
    starts = np.cumsum(counts) - counts
    return np.repeat(np.arange(len(counts)), n), ragged(np.zeros(len(n), np.int64), n), ragged(starts, n)


def _least(grams: np.ndarray) -> np.ndarray:
    """The least of each window's WINDOW - GRAM + 1 gram hashes."""
    width, have = WINDOW - GRAM + 1, 1
    while 2 * have <= width:
        grams = np.minimum(grams[:-have], grams[have:])
        have *= 2
    return np.minimum(grams[: len(grams) - (width - have)], grams[width - have :])


def _derived(texts: list[bytes | None]):
    """Row, position, representative gram and (on call) verifying hashes of every window."""
    words, counts = _word_hashes(texts)
    row, pos, at = _windows(counts)
    if not len(at):
        return row, pos, np.zeros(0, np.uint64), None
    grams, whole = _rolling[0](words[0], GRAM, WINDOW)
    return row, pos, _least(grams)[at], lambda keep: (whole[at[keep]], _rolling[1](words[1], WINDOW)[0][at[keep]])


#: Columns of the documents inside: the mark stands for the row's doc_id and text together.
_KEYED = ["doc_id", "xxhash64(text) as text_key", "xxhash64(doc_id, text) as mark", "text"]


def _texts(batch: pa.RecordBatch, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """doc_ids, text keys and texts; those to skip are None."""
    ids, keys, marks = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1, 2))
    texts = batch.column(3).cast(pa.binary()).to_pylist()
    if len(skip):
        for i in np.flatnonzero(skip[np.minimum(np.searchsorted(skip, marks), len(skip) - 1)] == marks).tolist():
            texts[i] = None
    return ids, keys, texts


def grams(docs: DataFrame, skip) -> DataFrame:
    """(gram, doc_id): the representative grams of each document, each once, as a rule."""

    def find(batches):
        for batch in steps(batches, "text", STEP):
            ids, _, texts = _texts(batch, skip.value)
            row, _, gram, _ = _derived(texts)
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(gram[fresh].view(np.int64)), pa.array(ids[row[fresh]])], ["gram", "doc_id"])

    return docs.selectExpr(*_KEYED).mapInArrow(find, "gram long, doc_id long")


def _filter(hashes: DataFrame) -> tuple[list | None, int]:
    """Marks of a Bloom filter of a written table's hashes (None if too many to broadcast) and its segments."""
    segments = segments_for(hashes.count())

    def build(batches):
        found = [np.asarray(b.column(0)).view(np.uint64) for b in batches if b.num_rows]
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield from filter_rows(hashes, hashes[:0], segments)

    return small(written(merged(hashes.mapInArrow(build, SCHEMA), "once", segments))), segments


_FOUND = "w1 long, w2 long, doc_id long, text_key long, first int, last int, settled boolean, fresh boolean"


def _candidates(docs: DataFrame, suspects: DataFrame, holders: DataFrame, fresh: bool, skip, named: DataFrame | None = None) -> DataFrame:
    """Windows whose gram is suspected. In each step the smallest document's are listed for the shuffle; stretches of
    windows of later documents are settled if the documents are ``fresh``: they go. Only the documents ``named`` by the hashes of
    their doc_ids are split into windows, all if none is given. Where a filter is too large to broadcast, ``holders``
    (gram, doc_id) gives each document its own suspected grams instead."""
    (marks, segments), (names, name_segments) = _filter(suspects), _filter(named) if named else (None, 1)
    shared = docs.sparkSession.sparkContext.broadcast((marks, names))
    keyed = docs.selectExpr(*_KEYED, *(["xxhash64(doc_id) as name"] if names is not None and marks is not None else []))
    if marks is None:
        own = holders.join(suspects, "gram", "left_semi").groupBy(F.col("doc_id").alias("holder")).agg(F.collect_set("gram").alias("grams"))
        keyed = keyed.join(own, keyed["doc_id"] == own["holder"]).drop("holder")

    def find(batches):
        marks, names = shared.value
        known = Filter(marks, segments) if marks is not None else None
        wanted = Filter(names, name_segments) if names is not None and known else None
        for batch in steps(batches, "text", STEP):
            ids, keys, texts = _texts(batch, skip.value)
            if wanted:
                hit = wanted.holds(np.asarray(batch.column(4)).view(np.uint64))
                texts = [t if h else None for t, h in zip(texts, hit)]
            row, pos, gram, verify = _derived(texts)
            if not len(gram):
                continue
            if known:
                keep = np.flatnonzero(known.holds(gram))
            else:
                own = [np.asarray(batch.column(4)[i].values).view(np.uint64) for i in range(len(ids))]
                edges = np.searchsorted(row, np.arange(len(ids) + 1))
                keep = np.flatnonzero(np.concatenate([np.isin(gram[a:b], g) for a, b, g in zip(edges, edges[1:], own)]))
            if not len(keep):
                continue
            row, pos, (w1, w2) = row[keep], pos[keep], verify(keep)
            order = np.lexsort((ids[row], w2, w1))
            row, pos, w1, w2 = row[order], pos[order], w1[order], w2[order]
            other = np.ones(len(w1), bool)
            other[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            owner = ids[row][np.flatnonzero(other)][np.cumsum(other) - 1]
            mine = ids[row] == owner
            parts = [(w1[mine].view(np.int64), w2[mine].view(np.int64), row[mine], pos[mine], pos[mine], False)]
            gone = ~mine & fresh
            r, p = row[gone], pos[gone]
            order = np.lexsort((p, r))
            r, p = r[order], p[order]
            if len(r):
                first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)]))
                last = np.append(first[1:], len(r)) - 1
                none = np.zeros(len(first), np.int64)
                parts.append((none, none, r[first], p[first], p[last], True))
            for a, b, r, first, last, settled in parts:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ids[r]), pa.array(keys[r]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(np.full(len(r), settled)), pa.array(np.full(len(r), fresh))], ["w1", "w2", "doc_id", "text_key", "first", "last", "settled", "fresh"])

    return keyed.mapInArrow(find, _FOUND)


def met(new: DataFrame, old: DataFrame) -> DataFrame:
    """The grams of a new run that an old one holds: a merge join of two sorted runs."""
    return new.select("gram").join(old.select("gram").hint("merge"), "gram", "left_semi")


LOST = "doc_id long, text_key long, first int, last int"
_TABLES = {"grams": ("gram", "gram BIGINT, doc_id BIGINT"), "texts": ("text_key", "text_key BIGINT, other_key BIGINT, owner BIGINT")}


def _name(path: str) -> str:
    """The table of a run in the session's catalogue."""
    return f"run_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


class FingerprintIndex:
    """Immutable bucketed and sorted runs in ``folder``; opening a folder that holds an index goes on with it.

    A state file lists the runs; it is written last. ``close`` takes the runs out of the session's catalogue."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        system, root = file_system(spark, self.folder)
        states = sorted(s.getPath().toString() for s in system.listStatus(root)) if system.exists(root) else []
        states = [s for s in states if "/state-" in s and system.exists(file_system(spark, s + "/_SUCCESS")[1])]
        if states:
            self.state = json.loads(spark.read.text(states[-1]).first()[0])
        else:
            self.state = {"version": 0, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": []}

    def _write(self, kind: str, rows: DataFrame, path: str) -> None:
        """One file for each bucket, sorted, so that readers need neither exchange nor sort."""
        key, n, name = _TABLES[kind][0], self.state["buckets"], f"run_{uuid.uuid4().hex}"
        rows.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # external: the files stay

    def run(self, kind: str, path: str) -> DataFrame:
        """A run as a table; in a new session it is declared again."""
        key, columns = _TABLES[kind]
        name = _name(path)
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # buckets of one file keep their order
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.state['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def history(self, kind: str) -> list[DataFrame]:
        return [self.run(kind, r[kind]) for r in self.state["runs"]]

    def _copies(self, docs: DataFrame, path: str) -> DataFrame:
        """(mark, doc_id, text_key) of the batch's documents whose whole text an earlier document holds."""
        keyed = docs.selectExpr(*_KEYED[:3], "xxhash64(1, text) as other_key")
        first = written(keyed.groupBy("text_key", "other_key").agg(F.min("doc_id").alias("owner")))
        self._write("texts", first, path)
        own, both = self.run("texts", path).withColumn("old", F.lit(False)), ["text_key", "other_key"]
        for past in self.history("texts"):
            past = past.select(F.col("text_key").alias("k"), F.col("other_key").alias("o"))
            own = own.join(past.hint("merge"), (own["text_key"] == past["k"]) & (own["other_key"] == past["o"]), "left").select(*both, "owner", (F.col("old") | F.col("k").isNotNull()).alias("old"))
        return written(keyed.join(own, both).where("old or doc_id > owner").select("mark", "doc_id", "text_key"))

    def add(self, docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Index new documents (doc_id, text); LOST: stretches of windows that they lose.

        ``known`` holds the documents added before (others in it don't matter if their doc_ids differ); of these only those
        that hold a suspected gram are split into words."""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
        if docs.isEmpty():
            return self.spark.createDataFrame([], LOST)
        self._compact()
        level = f"{self.folder}/run-{uuid.uuid4().hex}"
        copies = self._copies(docs, f"{level}/texts")
        marks = np.zeros(0, np.int64)
        if copies.count() <= MOST_COPIES:
            marks = np.sort(np.asarray(copies.select("mark").toArrow().column(0)).astype(np.int64))
        skip = self.spark.sparkContext.broadcast(marks)
        self._write("grams", grams(docs, skip), f"{level}/grams")
        run, past = self.run("grams", f"{level}/grams"), self.history("grams")
        shared = [run.groupBy("gram").agg((F.min("doc_id") < F.max("doc_id")).alias("shared")).where("shared").select("gram")]
        shared += [met(run, old) for old in past]
        suspects = written(_union(shared).distinct())
        found = _candidates(docs, suspects, run, True, skip)
        if past and known is not None:
            # the runs say which historical documents hold a suspected gram
            holders = written(_union([old.join(suspects, "gram", "left_semi") for old in past]))
            named = written(holders.select("doc_id").distinct())
            old_docs = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            if named.count() <= MOST_NAMED:
                old_docs, named = old_docs.join(F.broadcast(named), "doc_id", "left_semi"), None
            names = written(named.select(F.xxhash64("doc_id").alias("name"))) if named else None
            none = self.spark.sparkContext.broadcast(np.zeros(0, np.int64))
            old = _candidates(old_docs, suspects, holders, False, none, names)
            found = found.unionByName(old.join(named, "doc_id", "left_semi") if named else old)  # less what the filter let pass
        found = written(found)
        open_rows = found.where("not settled").withColumn("place", F.struct("fresh", "doc_id"))
        firsts = open_rows.groupBy("w1", "w2").agg(F.min("place").alias("owner"), F.max("place").alias("most")).where("owner < most").select("w1", "w2", "owner")
        lost = open_rows.join(firsts, ["w1", "w2"]).where("fresh and place > owner")
        columns = ["doc_id", "text_key", "first", "last"]
        whole = copies.select("doc_id", "text_key", F.lit(0).alias("first"), F.lit(ALL).alias("last"))
        self._commit([*self.state["runs"], {"level": 0, "grams": f"{level}/grams", "texts": f"{level}/texts"}])
        return lost.select(columns).union(found.where("settled").select(columns)).union(whole)

    def close(self) -> None:
        for r in self.state["runs"]:
            for kind in _TABLES:
                self.spark.sql(f"DROP TABLE IF EXISTS {_name(r[kind])}")

    def _commit(self, runs: list[dict]) -> None:
        self.state |= {"version": self.state["version"] + 1, "runs": runs}
        state = self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1)
        state.write.text(f"{self.folder}/state-{self.state['version']:08d}")

    def _compact(self) -> None:
        """Merge the last two runs while their levels agree; old files go once the new state is written."""
        while len(runs := self.state["runs"]) > 1 and runs[-1]["level"] == runs[-2]["level"]:
            a, b = runs[-2:]
            new, path = {"level": a["level"] + 1}, f"{self.folder}/run-{uuid.uuid4().hex}"
            for kind in _TABLES:
                rows = self.run(kind, a[kind]).union(self.run(kind, b[kind]))
                if kind == "texts":
                    rows = rows.groupBy("text_key", "other_key").agg(F.min("owner").alias("owner"))
                new[kind] = f"{path}/{kind}"
                self._write(kind, rows, new[kind])
            self._commit([*runs[:-2], new])
            for old in (a, b):
                for kind in _TABLES:
                    self.spark.sql(f"DROP TABLE IF EXISTS {_name(old[kind])}")
                    removed(self.spark, old[kind])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _stretches(batches):
    """Neighbouring windows of a document joined into stretches; ALL stands for the rest."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            first, last = (np.asarray(batch.column(j)[i].values).astype(np.int64) for j in (2, 3))
            if (last == ALL).any():
                out.append(([0], [ALL]))
                continue
            order = np.argsort(first, kind="stable")
            first, reach = first[order], np.maximum.accumulate(last[order])
            cut = np.flatnonzero(first[1:] > reach[:-1] + WINDOW)
            out.append((first[np.append(0, cut + 1)].tolist(), reach[np.append(cut, len(reach) - 1)].tolist()))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([o[j] for o in out], kind) for j in (0, 1))], ["loser", "lost_key", "firsts", "lasts"])


def without_windows(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """The input by position (c0, c1, ...), n_words, n_removed and kept_text, given LOST of its documents.

    Texts stay where they are if few documents lose anything, else they meet their stretches in a shuffle."""
    names, df = docs.columns, positional(docs)
    at, doc_id = names.index("text"), f"c{names.index('doc_id')}"
    lists = lost.groupBy(F.col("doc_id").alias("loser"), F.col("text_key").alias("lost_key")).agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    lists = written(lists.mapInArrow(_stretches, lists.schema))
    if lists.count() <= MOST_LOSERS:
        lists = F.broadcast(lists)
    joined = df.join(lists, (df[doc_id].cast("long") == F.col("loser")) & (F.xxhash64(df[f"c{at}"]) == F.col("lost_key")), "left").select(*df.columns, "firsts", "lasts")

    def apply(batches):
        for batch in steps(batches, f"c{at}"):
            n_words, n_removed, kept_text = [], [], []
            for i, text in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                words = text.split() if text else []
                n_words.append(len(words))
                if batch.column(len(names))[i].is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    first, last = (np.asarray(batch.column(len(names) + j)[i].values) for j in (0, 1))
                    if len(words) >= WINDOW and (last == ALL).any():
                        edge[0] = 1
                    first, last = first[last != ALL], last[last != ALL]
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + WINDOW, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept_text.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string())], [*(f"c{i}" for i in range(len(names))), "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(apply, extended(df, "n_words long, n_removed long, kept_text string"))


def cleaned(docs: DataFrame, batches: int = 3, folder: str | None = None) -> DataFrame:
    """``without_windows`` of documents that enter a new index in so many batches of ascending doc_id."""
    spark, names = docs.sparkSession, docs.columns
    df = positional(docs).select(F.col(f"c{names.index('doc_id')}").cast("long").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"))
    shares = [(i + 1) / batches for i in range(batches - 1)]
    row = df.agg(F.percentile_approx("doc_id", shares or [0.5]).alias("cuts"), F.max("doc_id").alias("most")).first()
    lost = [spark.createDataFrame([], LOST)]
    if row["most"] is not None:
        index, after = FingerprintIndex(spark, folder or scratch(spark)), None
        for upto in sorted({*(row["cuts"] if shares else []), row["most"]}):
            batch = df.where(F.col("doc_id") <= upto)
            lost.append(index.add(batch) if after is None else index.add(batch.where(F.col("doc_id") > after), df.where(F.col("doc_id") <= after)))
            after = upto
        index.close()
    return without_windows(docs, _union(lost))


def substring_dedup(docs: DataFrame, batches: int = 3) -> DataFrame:
    """The input columns, n_words, n_removed and kept_text (words joined by one space)."""
    own = ("n_words", "n_removed", "kept_text")
    return named(cleaned(docs, batches), docs.columns, own, own)


def without_repeats(docs: DataFrame, batches: int = 3) -> DataFrame:
    """The input, all columns as they were, but for texts that lose words."""
    at = f"c{docs.columns.index('text')}"
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(at))
    return named(cleaned(docs, batches).withColumn(at, text), docs.columns, (), ())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE_SQL = {
    "op7_substring_dedup": rf"""
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM split, unnest(range(1, len(w) - {WINDOW - 2})) AS r(i)
), firsts AS (
    SELECT h, min(doc_id) AS owner FROM windows GROUP BY h
), gone AS (
    SELECT DISTINCT doc_id, i + k AS pos FROM windows JOIN firsts USING (h), range({WINDOW}) AS o(k) WHERE doc_id > owner
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM split
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)
"""
}
