"""Bloom filters in segments, sized from the number of keys, for hashes that occur once and twice.

Tasks list the bits that their own rows set, a shuffle by segment merges them, and a pair of filters merges as
``o1 | o2`` and ``t1 | t2 | (o1 & o2)``, so no key that two tasks hold is missed. A key sets ``PROBES`` bits of one
segment, and a filter has ``BITS_PER_KEY`` bits a key, so a tenth of the bits are set at most and one key in a
hundred is suspected wrongly, whatever the input. ``suspected`` counts the set bits of the wanted filter: up to
``MOST_MARKS`` of them are broadcast (two bytes each); more are joined with the rows' bit numbers by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BITS_PER_KEY, SEGMENT, PROBES, MOST_MARKS = 20, 1 << 16, 2, 1 << 25
SCHEMA = "segment long, once binary, twice binary"
MARKS = "segment long, marks binary"


def segments_for(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // SEGMENT))


def bit_numbers(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Bit numbers of each hash, all in one segment: shape (n, PROBES)."""
    base = (hashes >> np.uint64(32)) % np.uint64(segments) * np.uint64(SEGMENT)
    return np.stack([base + ((hashes >> np.uint64(16 * i)) & np.uint64(SEGMENT - 1)) for i in range(PROBES)], axis=1).astype(np.int64)


def bit_sql(column: str, segments: int, probe: int) -> str:
    """The same as a SQL expression over a long column."""
    return f"pmod(shiftrightunsigned({column}, 32), {segments}L) * {SEGMENT}L + (shiftrightunsigned({column}, {16 * probe}) & {SEGMENT - 1}L)"


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[edges[i]:edges[i + 1]]."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def filter_rows(once: np.ndarray, twice: np.ndarray, segments: int):
    """Record batches of SCHEMA: the bits that these hashes set, as places in their segments."""
    once, twice = np.unique(bit_numbers(once, segments)), np.unique(bit_numbers(twice, segments))
    names = np.unique(once // SEGMENT)
    for at in range(0, len(names), 1 << 12):
        own = names[at : at + (1 << 12)]
        columns = [pa.array(own)]
        for bits in (once, twice):
            edges = np.append(np.searchsorted(bits, own * SEGMENT), np.searchsorted(bits, (own[-1] + 1) * SEGMENT))
            columns.append(_cut((bits[edges[0] : edges[-1]] % SEGMENT).astype(np.uint16), edges - edges[0]))
        yield pa.RecordBatch.from_arrays(columns, ["segment", "once", "twice"])


def merged(built: DataFrame, column: str, segments: int) -> DataFrame:
    """Rows of SCHEMA merged by segment: (segment, marks), the places set in the named filter."""
    pick = ["once", "twice"].index(column)

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, *places in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = (np.frombuffer(p, np.uint16) for p in places)
                if s not in held:
                    held[s] = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
                o, t = held[s]
                t[twice] = True
                t[once[o[once]]] = True
                o[once] = True
        for s in sorted(held):
            marks = np.flatnonzero(held[s][pick]).astype(np.uint16)
            if len(marks):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([marks.tobytes()], pa.binary())], ["segment", "marks"])

    # 256 segments a task at most, as a rule: 32 MB
    tasks = max(int(built.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments // 256)
    return built.repartition(min(tasks, segments), "segment").mapInArrow(merge, MARKS)


class Filter:
    """Tests hashes against the broadcast marks of a filter."""

    def __init__(self, rows: list[tuple[int, bytes]], segments: int):
        rows = sorted(rows)
        kind = np.uint32 if segments * SEGMENT < 1 << 32 else np.int64
        self.segments = segments
        self.bits = np.concatenate([np.frombuffer(m, np.uint16).astype(kind) + kind(s * SEGMENT) for s, m in rows]) if rows else np.zeros(0, kind)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.bits) or not len(hashes):
            return np.zeros(len(hashes), bool)
        bits = bit_numbers(hashes, self.segments).astype(self.bits.dtype)
        return (self.bits[np.minimum(np.searchsorted(self.bits, bits), len(self.bits) - 1)] == bits).all(axis=1)


def small(marks: DataFrame) -> list[tuple[int, bytes]] | None:
    """The rows of a written table of marks, or None if they are too many to broadcast."""
    total = marks.agg(F.sum(F.length("marks"))).first()[0] or 0
    return [tuple(r) for r in marks.collect()] if total <= 2 * MOST_MARKS else None


def suspected(rows: DataFrame, column: str, marks: DataFrame, segments: int) -> DataFrame:
    """The rows whose hash (a long) the filter of ``marks`` may hold."""
    held = small(marks)
    if held is None:

        def bits(batches):
            for batch in batches:
                for s, m in zip(*(c.to_pylist() for c in batch.columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(m, np.uint16).astype(np.int64) + s * SEGMENT)], ["bit"])

        known = written(marks.mapInArrow(bits, "bit long"))
        for i in range(PROBES):
            rows = rows.withColumn("bit", F.expr(bit_sql(column, segments, i))).join(known, "bit", "left_semi").drop("bit")
        return rows
    shared, at = rows.sparkSession.sparkContext.broadcast(held), rows.columns.index(column)

    def pick(batches):
        known = Filter(shared.value, segments)
        for batch in batches:
            yield batch.filter(pa.array(known.holds(np.asarray(batch.column(at)).view(np.uint64))))

    return rows.mapInArrow(pick, rows.schema)
