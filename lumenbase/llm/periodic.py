"""Periodic runs inside texts: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of words with smallest period q and at least ``max(LEAST, TIMES * q)`` words that no neighbouring
word extends. Each block of words is cut at its midpoint. Z-functions of the right half, and of the left half backwards,
say for each period how far the words before and after the midpoint go on with it, with the period taken to the right or to
the left of the midpoint; what crosses the midpoint and is long enough is a repetition. One that goes on beyond its block is
left to the block around it, so each run is met whole in just one block. Of equal intervals the smallest period stays.

Most words lie in no run, so blocks start as the regions that can hold one: every 8 words of a run come again q words later,
and the places that are followed by a copy of themselves form a stretch at least about twice as long as the distance.
Positions whose next copy is farther than their stretch allows are left out until nothing changes; no run is lost, and
nothing else finds runs.

A scan and a map: nothing is shuffled, and a task holds a step of ``STEP_BYTES`` of texts or one longer text.

Defined results: null, empty and short texts have no runs and collapse to their words; repeated rows give repeated results,
equal and null doc_ids are no matter; an empty table gives no rows; other columns pass through, less those that the results
name. The collapsed text has its words joined by one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extended, named, positional, ragged, steps

LEAST, TIMES, GRAM = 24, 3, 8
BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = "n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"


def z_function(s: list[int]) -> list[int]:
    """For each place how many items from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(0, right - i)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def matches(text: list[int], places: int, pattern: list[int], z: list[int]) -> list[int]:
    """For each of the first ``places`` of the text how many items from there on equal those of the pattern, whose Z-function is given."""
    out, n, m = [0] * places, len(text), len(pattern)
    left = right = 0
    for i in range(places):
        k = z[i - left] if i < right and i - left < m else 0
        if i + k >= right:
            k = max(0, right - i)
            while i + k < n and k < m and pattern[k] == text[i + k]:
                k += 1
            left, right = i, i + k
        out[i] = k
    return out


def _crossing(ids: np.ndarray, lo: int, mid: int, hi: int, found: dict[tuple[int, int], int]) -> None:
    """Add the runs inside [lo, hi) that cross ``mid``: (start, end) with the smallest period."""
    block, m, most = ids[lo:hi].tolist(), mid - lo, (hi - lo) // TIMES
    right, back = block[m:], block[:m][::-1]
    z_right, z_back = z_function(right), z_function(back)
    p = min(most, len(right))  # the period lies to the right of the midpoint
    before = np.array(matches(block[: m + p][::-1], p, back, z_back)[::-1], np.int64)  # of period 1, 2, ..., p
    after = np.array([*z_right[1 : p + 1], 0][:p], np.int64)
    period = np.arange(1, p + 1)
    starts, ends, periods = [mid - before], [mid + period + after], [period]
    p = min(most, len(back))  # to the left of it
    after = np.array(matches(block[m - p :], p, right, z_right)[::-1], np.int64)
    before = np.array([*z_back[1 : p + 1], 0][:p], np.int64)
    period = np.arange(1, p + 1)
    start, end, period = np.concatenate([*starts, mid - period - before]), np.concatenate([*ends, mid + after]), np.concatenate([*periods, period])
    keep = (start < mid) & (end > mid) & (end - start >= np.maximum(LEAST, TIMES * period))
    if not keep.any():
        return
    start, end, period, n = start[keep], end[keep], period[keep], len(ids)
    left, beyond = np.maximum(start - 1, 0), np.minimum(end, n - 1)
    goes_on = ((start == lo) & (start > 0) & (ids[left] == ids[left + period])) | ((end == hi) & (end < n) & (ids[beyond] == ids[beyond - period]))
    for s, e, q in zip(start[~goes_on].tolist(), end[~goes_on].tolist(), period[~goes_on].tolist()):
        if q < found.get((s, e), q + 1):
            found[s, e] = q


def main_lorentz(ids: np.ndarray, stretches: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a word sequence, by start and period; all of them lie in the stretches, if given."""
    found: dict[tuple[int, int], int] = {}
    blocks = [(0, len(ids))] if stretches is None else list(stretches)
    while blocks:
        lo, hi = blocks.pop()
        if hi - lo >= LEAST:
            mid = (lo + hi) // 2
            _crossing(ids, lo, mid, hi, found)
            blocks += [(lo, mid), (mid, hi)]
    return sorted((s, e - s, q) for (s, e), q in found.items())


def regions(ids: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each row of the joined ``ids`` the stretches (in the row) that hold all its runs."""
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.maximum(counts - (GRAM - 1), 0)
    at = ragged(starts, n)
    if not len(at):
        return out
    grams = np.zeros(max(0, len(ids) - GRAM + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            grams = grams * BASE + ids[k : len(ids) - GRAM + 1 + k].astype(np.uint64) + np.uint64(1)
    order = at[np.argsort(grams[at], kind="stable")]
    row = np.repeat(np.arange(len(counts)), counts)
    same = (grams[order[1:]] == grams[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    here, gap = order[:-1][same], (order[1:] - order[:-1])[same]
    keep = gap <= counts[row[here]] // TIMES
    by = np.argsort(here[keep], kind="stable")
    here, gap = here[keep][by], gap[keep][by]
    while len(here):
        cut = np.flatnonzero((here[1:] != here[:-1] + 1) | (row[here[1:]] != row[here[:-1]]))
        first, last = np.append(0, cut + 1), np.append(cut, len(here) - 1)
        size = last - first + 1
        # a run of period q has at least max(LEAST, TIMES * q) - q - GRAM + 1 such places in a row
        most = np.where(size >= LEAST - LEAST // TIMES - GRAM + 1, (size + GRAM - 1) // (TIMES - 1), 0)
        keep = gap <= np.repeat(most, size)
        if keep.all():
            for a, b, q in zip(here[first].tolist(), here[last].tolist(), most.tolist()):
                r = row[a]
                begin, end = a - starts[r], min(int(counts[r]), b - starts[r] + q + GRAM)
                if out[r] and begin <= out[r][-1][1]:
                    begin, end = out[r][-1][0], max(end, out[r].pop()[1])
                out[r].append((int(begin), int(end)))
            break
        here, gap = here[keep], gap[keep]
    return out


class _Interned(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def find_runs(texts: list[bytes | None]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs (start, length, period)."""
    split = [t.split() if t else [] for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    number = _Interned().__getitem__
    ids = np.fromiter((number(w) for words in split for w in words), np.int64, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    places = regions(ids, counts)
    return [(words, main_lorentz(ids[s : s + len(words)], own) if own else []) for words, s, own in zip(split, starts.tolist(), places)]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: those of a run after its first period go."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The input columns with n_words, n_runs, runs (by start and period) and collapsed_text."""
    names, df = docs.columns, positional(docs)
    at, own = names.index("text"), ("n_words", "n_runs", "runs", "collapsed_text")

    def find(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in steps(batches, f"c{at}"):
            found = find_runs(batch.column(at).cast(pa.binary()).to_pylist())
            texts = [b" ".join(w if not runs else [w[i] for i in np.flatnonzero(kept_words(len(w), runs)).tolist()]) for w, runs in found]
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r in found]
            columns = [pa.array([len(w) for w, _ in found], pa.int64()), pa.array([len(r) for _, r in found], pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *own])

    return named(df.mapInArrow(find, extended(df, RESULT)), names, own, own)


def planted(text: Column, doc_id: Column) -> Column:
    """Texts of which one in ten, by a checksum of doc_id, goes on periodically from some word on; null ids stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    # bound once by a transform over an array of one: the words, then a and p
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def repeat(w):
        n = F.size(w).cast("long")
        a = F.when(n > 0, F.pmod(g, F.greatest(n, F.lit(1))))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda s: F.array_join(F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, (s["a"] + F.pmod(i - s["a"], s["p"])).cast("int")))), " ")), "")

    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), repeat), 1)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    # greatest length over period first; decimal products compare the quotients exactly
    cross = "cast(a.length as decimal(19)) * b.period <=> cast(b.length as decimal(19)) * a.period"
    better = "case when cast(a.length as decimal(19)) * b.period > cast(b.length as decimal(19)) * a.period then -1 when not (" + cross + ") then 1 when a.start <> b.start then int(sign(a.start - b.start)) else int(sign(a.period - b.period)) end"
    out = out.withColumn("best", F.expr(f"get(array_sort(runs, (a, b) -> {better}), 0)"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
