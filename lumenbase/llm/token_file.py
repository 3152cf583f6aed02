"""Token-id files: static range asymmetric numeral coding (rANS) of token ids in independent interleaved blocks.

One frequency table, counted over all ids, serves every block. A block holds whole documents, up to ``BLOCK`` ids
(one longer document makes a block of its own). Its ids are dealt to interleaved lanes row by row; each lane is a
64-bit rANS state that emits 32-bit words. Every ``EVERY`` rows a checkpoint keeps all lane states and the word
position, so the stretches between checkpoints are decoded side by side, and checksums cover words and ids.
Files are Parquet rows (one a block), so Spark's committer, retries and readers apply as they are.

Defined results: null text is empty and holds only the end id; documents come in ascending doc_id, nulls first, equal
ids in scan order; an empty table writes a table and no block; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch
from .tokens import id_type, part_bases, token_table

BLOCK, LANES, EVERY = 1 << 20, 2048, 128
LOW = np.uint64(1 << 31)
BLOCKS = (
    "part int, block int, start long, n_tokens long, lanes int, states binary, marks binary, words binary, words_crc32 long, ids_crc32 long, doc_ids array<long>, doc_tokens array<long>"
)


def frequencies(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Whole frequencies that sum to 2**bits, at least 1 for each id that occurs."""
    used = np.flatnonzero(counts)
    bits = max(16, int(np.ceil(np.log2(max(1, len(used))))) + 2)
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        return freq, bits
    freq[used] = np.maximum(1, np.floor(counts[used] * float((1 << bits) - len(used)) / counts[used].sum()).astype(np.int64))
    freq[used[np.argmax(freq[used])]] += (1 << bits) - int(freq.sum())
    return freq, bits


class Tables:
    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.low = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int64), freq)
        self.common = int(np.argmax(freq)) if len(freq) else 0


def encode_block(ids: np.ndarray, t: Tables, lanes: int, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane states at each checkpoint, the words before each, and all words in decoding order."""
    rows = -(-len(ids) // lanes)
    grid = np.full(rows * lanes, t.common, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(rows, lanes)
    x = np.full(lanes, LOW, np.uint64)
    limit_shift, word = np.uint64(63) - t.bits, np.uint64(32)
    out, states, sizes = [], [], np.zeros(rows, np.int64)
    for r in range(rows - 1, -1, -1):
        f, c = t.freq[grid[r]], t.low[grid[r]]
        full = x >= (f << limit_shift)
        emitted = x[full].astype(np.uint32)
        out.append(emitted)
        sizes[r] = len(emitted)
        x = np.where(full, x >> word, x)
        q = x // f
        x = (q << t.bits) + (x - q * f) + c
        if r % every == 0:
            states.append(x)
    before = np.concatenate([[0], np.cumsum(sizes)])[:rows:every]
    return np.stack(states[::-1]) if states else np.zeros((0, lanes), np.uint64), before, np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)


def decode_block(n: int, states: np.ndarray, marks: np.ndarray, words: np.ndarray, t: Tables, every: int = EVERY) -> np.ndarray:
    """All stretches between checkpoints at once."""
    stretches, lanes = states.shape
    rows = -(-n // lanes)
    grid = np.empty((stretches, every, lanes), np.int64)
    x, at, mask, word = states.copy(), marks.copy(), (np.uint64(1) << t.bits) - np.uint64(1), np.uint64(32)
    words = words.astype(np.uint64)
    for r in range(min(every, rows)):
        live = stretches if (stretches - 1) * every + r < rows else stretches - 1
        y = x[:live]
        slot = y & mask
        s = t.symbol[slot]
        grid[:live, r] = s
        y = t.freq[s] * (y >> t.bits) + slot - t.low[s]
        short = y < LOW
        taken = short.sum(1)
        where = np.repeat(at[:live] - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))
        y[short] = (y[short] << word) | words[where]
        at[:live] += taken
        x[:live] = y
    return grid.reshape(stretches * every, lanes).reshape(-1)[:n]


def _blocks(part: int, documents_of, width: str, tables: Tables):
    """Block rows from (doc_id, ids bytes) in order."""
    start, number, held, ids, counts = 0, 0, 0, [], []

    def flush():
        nonlocal start, number, held, ids, counts
        block = np.concatenate(ids)
        lanes = LANES if len(block) >= 64 * LANES else 128 if len(block) >= 1 << 13 else 16
        states, marks, words = encode_block(block.astype(np.int64), tables, lanes)
        row = [part, number, start, len(block), lanes, states.tobytes(), marks.tobytes(), words.tobytes(), zlib.crc32(words), zlib.crc32(block.astype("<u4")), counts, [len(i) for i in ids]]
        start, number, held, ids, counts = start + len(block), number + 1, 0, [], []
        return row

    for doc_id, raw in documents_of:
        own = np.frombuffer(raw, width)
        if held and held + len(own) > BLOCK:
            yield flush()
        ids.append(own)
        counts.append(doc_id)
        held += len(own)
    if held:
        yield flush()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write ``path/table`` (frequencies), ``path/blocks`` and ``path/parts`` (ids before each part)."""
    spark = docs.sparkSession
    table = token_table(docs, tokenizer, end_id)
    width = id_type(tokenizer)

    def listed(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                totals = np.frombuffer(raw, np.int64)
                used = np.flatnonzero(totals)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["id", "n"])

    # one row for each id of the vocabulary, so its size bounds what reaches the driver
    tallies = table.select("counts").where("counts is not null")
    found = tallies.mapInArrow(listed, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in found], default=-1) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    freq, bits = frequencies(counts)
    spark.createDataFrame([(bits, freq.astype("<i8").tobytes())], "bits int, frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    packed = freq.astype(np.int32)

    def encode(batches):
        from pyspark import TaskContext

        part, tables = TaskContext.get().partitionId(), Tables(packed.astype(np.int64), bits)
        rows = ((d, raw) for batch in batches for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("lanes", pa.int32()), ("states", pa.binary()), ("marks", pa.binary()), ("words", pa.binary()), ("words_crc32", pa.int64()), ("ids_crc32", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))])
        for row in _blocks(part, rows, width, tables):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    ordered = table.where("counts is null").repartitionByRange("doc_id", "part", "local_start").sortWithinPartitions("doc_id", "part", "local_start")
    ordered.select("doc_id", "ids").mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    part_bases(spark.read.parquet(f"{path}/blocks")).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document; a block that fails a checksum raises."""
    bits, raw = spark.read.parquet(f"{path}/table").first()
    packed = np.frombuffer(raw, "<i8").astype(np.int32)
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/parts")), "part")
    blocks = blocks.select((F.col("base") + F.col("start")).alias("start"), "n_tokens", "lanes", "states", "marks", "words", "words_crc32", "ids_crc32", "doc_ids", "doc_tokens")

    def decode(batches):
        tables = Tables(packed.astype(np.int64), bits)
        for batch in batches:
            for i in range(batch.num_rows):
                start, n, lanes, states, marks, words, words_crc, ids_crc, doc_ids, sizes = (c[i].as_py() for c in batch.columns)
                if zlib.crc32(words) != words_crc:
                    raise ValueError("a block's words do not match their checksum")
                ids = decode_block(n, np.frombuffer(states, np.uint64).reshape(-1, lanes), np.frombuffer(marks, np.int64), np.frombuffer(words, np.uint32), tables).astype("<u4")
                if zlib.crc32(ids) != ids_crc:
                    raise ValueError("a block's ids do not match their checksum")
                stops = np.cumsum(sizes)
                starts = stops - sizes
                own = [ids[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + start), pa.array(sizes, pa.int64()), pa.array(own, pa.binary()), pa.array([zlib.crc32(o) for o in own], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark)
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path).drop("ids")


QUERIES = {"op5_token_file": op5_token_file}
ORACLE_SQL: dict[str, str] = {}
