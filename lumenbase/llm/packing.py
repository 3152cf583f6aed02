"""Packing: concatenate all documents' ids and cut the stream into fixed windows.

Pass one tokenizes each scan partition and counts the ids before each document inside it; the prefix sum of the
partition totals (one row a partition) gives every partition its global base. Pass two cuts each document at the
window borders that its global position crosses and writes one boundary record a piece. Nothing but the partition
totals is shuffled, and only the last window can need padding.

Defined results: null text is an empty text and packs as its end id alone; repeated rows and equal or null doc_ids
pack as separate documents, in scan order; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ragged
from .tokens import binaries, id_type, part_bases, token_table

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece of a document in a sequence, with its ids (little-endian unsigned 32-bit)."""
    table = token_table(docs, tokenizer, end_id)
    width = id_type(tokenizer)
    placed = table.where("counts is null").join(F.broadcast(part_bases(table)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "n_tokens", "ids")

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n = (np.asarray(batch.column(i)).astype(np.int64) for i in (1, 2))
            first, last = at // length, (at + n - 1) // length
            counts = last - first + 1
            row = np.repeat(np.arange(len(n)), counts)
            seq = ragged(first, counts)
            begin, end = np.maximum(at[row], seq * length), np.minimum((at + n)[row], (seq + 1) * length)
            ids = np.frombuffer(b"".join(batch.column(3).to_pylist()), width).astype("<u4")
            raw, size = ids.tobytes(), (end - begin)
            stops = np.cumsum(size) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((stops - size * 4).tolist(), stops.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(begin - at[row]), pa.array(size), binaries(ids, size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(begin - seq * length)],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the padded sequences; one whose length is a power of two stays as it is.

    A group holds at most ``length`` ids, so it is bounded.
    """

    def join(key, groups):
        for table in groups:
            order = np.argsort(np.asarray(table.column("offset")))
            ids = b"".join(table.column("ids").take(pa.array(order)).to_pylist())
            n = len(ids) // 4
            if n & (n - 1):
                ids += np.full(length - n, pad_id, "<u4").tobytes()
            yield pa.RecordBatch.from_pydict({"sequence_id": [key[0].as_py()], "ids": [ids]})

    def whole(key, table):
        return pa.Table.from_batches(list(join(key, [table])))

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(whole, "sequence_id long, ids binary")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
