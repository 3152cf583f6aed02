"""SimHash near-dedup with Golay-code fuzzy keys.

A fingerprint takes the majority of each bit over the XXH64 hashes of a text's word shingles. Fingerprints link at
two or fewer differing bits. Distinct fingerprints are cut into three segments of 22, 21 and 21 bits. Two linked
fingerprints agree on at least one whole segment (pigeonhole), and the next segment holds at most two errors. The
perfect [23,12] Golay code decodes each 23-bit word to one codeword, so two words at most two bits apart have a word
between them, at most one bit from both, that decodes to the same codeword: the codeword indices of a segment's
one-bit neighbourhood (one or six, as a rule) are keys that the two share. A key is (segment number, that whole
segment, codeword index of the next).

Fingerprints meet at their keys and are verified there by their distance. A bucket of up to ``MOST`` is sorted beside others and
each is compared with those that follow it. A larger one is split by the bits outside its whole segment: cut into chunks, two
errors leave all chunks but two alike, so each choice of two chunks to leave out gives a finer key of the rest, and two linked
fingerprints share one of these. Four chunks are tried first, ten where that does not do; the two chunks left out of ten have
ten bits at most, and fingerprints are distinct, so no bucket is larger than 1024 then. No link is lost and nothing is capped.
Tasks make forests of their links before anything is shuffled.

Defined results: null or empty text and text without words has fingerprint zero and links like any other; repeated
rows and equal doc_ids each get a row; a null doc_id is never the smallest of a component that has another; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, positional, steps, written
from .components import components, forest

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Fingerprints of a bucket that is not split, and the chunks of the splits in turn.
MOST, CHUNKS = 64, (4, 10)
#: Generator polynomial of the binary [23,12,7] Golay code.
GOLAY = 0xC75
#: Width and lowest bit of each segment.
SEGMENTS = [(22, 42), (21, 21), (21, 0)]


def _parity() -> np.ndarray:
    """The 11 check bits of each 12-bit message."""
    rest = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def _errors(parity: np.ndarray) -> np.ndarray:
    """For each syndrome the one error pattern of weight three or less."""
    ones = [1 << i for i in range(23)]
    patterns = [0, *ones, *(a | b for i, a in enumerate(ones) for b in ones[:i]), *(a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j])]
    patterns = np.array(patterns, np.int64)
    table = np.zeros(1 << 11, np.int64)
    table[parity[patterns >> 11] ^ (patterns & 0x7FF)] = patterns
    return table


class Golay:
    def __init__(self):
        self.parity = _parity()
        self.errors = _errors(self.parity)

    def decode(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword nearest to each 23-bit word."""
        return (words ^ self.errors[self.parity[words >> 11] ^ (words & 0x7FF)]) >> 11

    def nearby(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of the distinct codewords of every word's one-bit neighbourhood in its lowest ``width`` bits."""
        flips = np.array([0, *(1 << i for i in range(width))], np.int64)
        found = np.sort(self.decode(words[:, None] ^ flips), axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        row, _ = np.nonzero(fresh)
        return row, found[fresh]


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint's keys; two fingerprints at most two bits apart share one."""
    code, bits = Golay(), prints.astype(np.uint64)
    segments = [((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for width, low in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        row, index = code.nearby(segments[j], SEGMENTS[j][0])
        rows.append(row)
        keys.append((np.int64(i) << 34 | segments[i][row]) << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _prints(texts: list[bytes | None]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []  # bytes: only A-Z fold, only ASCII blanks split
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) < SHINGLE:
            hashes.append(digest(joined, SEED))
            counts[i] = 1
            continue
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(stops[: len(words) - SHINGLE] + 1).tolist()]
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, stops[SHINGLE - 1 :].tolist())]
        counts[i] = len(starts)
    prints = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return prints
    all_hashes, ends = np.array(hashes, ">u8"), np.cumsum(counts[full])
    begins, size = ends - counts[full], 1 << 18
    totals = np.zeros((len(full), 64), np.int64)
    for at in range(0, len(all_hashes), size):  # bits of so many hashes at a time
        part = np.unpackbits(all_hashes[at : at + size].view(np.uint8).reshape(-1, 8), axis=1)
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + len(part), "left")
        totals[first:last] += np.add.reduceat(part, np.maximum(begins[first:last] - at, 0), axis=0, dtype=np.int64)
    majority = (2 * totals > counts[full][:, None]).astype(np.uint8)
    prints[full] = np.packbits(majority, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return prints


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print): the 64-bit fingerprint as a signed long."""

    def compute(batches):
        for batch in steps(batches, "text", 4 << 20):
            prints = _prints(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(compute, "doc_id long, print long")


def _keyed(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 14):
            prints = np.asarray(batch.column(0).slice(at, 1 << 14))
            row, key = golay_keys(prints)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), np.int64)), pa.array(prints[row])], ["key", "part", "print"])


def finer(keys: np.ndarray, prints: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) of each fingerprint's finer keys: the bits outside its key's whole segment, less two chunks of them in all ways."""
    bits, whole = prints.view(np.uint64), keys >> 46
    rest = np.zeros(len(prints), np.int64)
    for i in range(3):
        others = [SEGMENTS[(i + 1) % 3], SEGMENTS[(i + 2) % 3]]
        joined, at = np.zeros(len(prints), np.int64), 0
        for width, low in others:
            joined |= ((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) << at
            at += width
        rest = np.where(whole == i, joined, rest)
    edges = [43 * c // chunks for c in range(chunks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    left = [masks[a] | masks[b] for a in range(chunks) for b in range(a)]
    parts = np.stack([np.int64(n + 1) << 43 | (rest & ~np.int64(m)) for n, m in enumerate(left)], axis=1)
    return np.repeat(np.arange(len(prints)), len(left)), parts.ravel()


def _met(batches):
    """Links within the buckets of sorted (key, part, print); the last bucket of a batch goes on in the next."""
    held = None
    for batch in _ended(batches):
        if batch is not None:
            now = np.stack([np.asarray(c) for c in batch.columns], axis=1)
            held = now if held is None else np.concatenate([held, now])
        if held is None or not len(held):
            continue
        done = len(held)
        if batch is not None:
            done = int(np.flatnonzero((held[:, :2] != held[-1, :2]).any(1))[-1]) + 1 if (held[:, :2] != held[-1, :2]).any() else 0
        rows, held = held[:done], held[done:]
        prints, step = rows[:, 2], 1
        left = np.arange(len(rows) - 1)
        while len(left):
            left = left[left + step < len(rows)]
            left = left[(rows[left, :2] == rows[left + step, :2]).all(1)]
            a, b = prints[left], prints[left + step]
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= MOST_BITS) & (a != b)
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[near]), pa.array(np.maximum(a, b)[near])], ["a", "b"])
            step += 1


def _ended(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _linked(batches):
    """Forests of the links: one function, so a task needs no second Python worker to contract what it has found."""
    yield from forest(_met(batches))


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column ``print``), in forests that connect all that link."""
    schema = "key long, part long, print long"
    rows, found = written(prints.mapInArrow(_keyed, schema)), []
    for chunks in (*CHUNKS, None):
        sizes = rows.groupBy("key", "part").agg(F.count("*").alias("n")).where("n > 1")
        sized = rows.join(sizes, ["key", "part"])
        small = sized.where(F.col("n") <= most) if chunks else sized
        sorted_ = small.select("key", "part", "print").repartition("key", "part").sortWithinPartitions("key", "part")
        found.append(sorted_.mapInArrow(_linked, "a long, b long"))
        if not chunks:
            break
        crowded = written(sized.where(F.col("n") > most).select("key", "print").distinct())
        if crowded.isEmpty():
            break

        def split(batches, chunks=chunks):
            for batch in batches:
                for at in range(0, batch.num_rows, 1 << 12):
                    keys, prints = (np.asarray(c.slice(at, 1 << 12)) for c in batch.columns)
                    row, part = finer(keys, prints, chunks)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(part), pa.array(prints[row])], ["key", "part", "print"])

        rows = crowded.mapInArrow(split, schema)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    table = written(fingerprints(docs, doc_id, text))
    prints = written(table.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(links(prints.select("print")), contracted=True)
    members = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    firsts = members.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(members.join(firsts, "root").select("print", "component_id"))
    return table.join(classes, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The input, all columns as they were, less the documents whose component has a smaller doc_id.

    Only the doc_ids that go are joined; Spark broadcasts them where they are few. Rows that repeat a doc_id stay or go
    together: they go if one of them has a smaller doc_id in its component. Rows without one, which cannot be told apart,
    stay."""
    df, at = positional(docs), f"c{docs.columns.index('doc_id')}"
    table = df.select(F.col(at).cast("long").alias("doc_id"), F.col(f"c{docs.columns.index('text')}").alias("text"))
    found = written(near_duplicates(table))
    gone = written(found.where("doc_id > component_id").select(F.col("doc_id").alias("gone")).distinct())
    return df.join(gone, df[at].cast("long") == gone["gone"], "left_anti").toDF(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
