"""Repair of conversations: an error-correcting Earley parser over the roles of their rows.

The grammar of roles is left-linear (``GRAMMAR``): a dialogue is nothing, or an optional system row and then user and assistant
in turn. A terminal is read by keeping a row of that role, by reroling a row or by inserting one; any item can delete a row and
stays as it is. As the grammar is left-linear, each item begins where the conversation begins, so a column of the chart has one
item a dotted production, with the least (cost, audit): an audit is the string of edits so far. An edit costs the same wherever it
stands and all items of a column have read the same rows, so of two audits of equal cost neither goes on from the other, and the
least of a whole is made of least parts.

Rows are equal if role and text are; equal rows of one turn are counted before they are shuffled, and equal rows of other
turns become markers of (turn, role, digest), so texts are not joined. Rows are then sorted over all tasks by conversation and
turn, so a conversation of any size lies in as many tasks as its rows need. A task parses a conversation that begins and ends in
it and has up to ``SEGMENT`` rows at once. Of others it writes segments, each parsed from every nonterminal that may stand before
it; the costs and audits of the segments are put together by conversation (a few letters a row), and a last pass takes the
segments' rows in order. A task holds a segment. What ends as one value stays in one task: a conversation's audit, and its
digest, which SHA-256 makes in one sequence.

Defined results: null roles and texts are one space, which is no role of the grammar and a blank text; a null conv_id is a
conversation; null turns come first; rows of one turn come by role, then by the first ``PREFIX`` characters and the MD5 digest of
their texts; texts are equal if role and digest are; a conversation without rows has an empty audit; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import share_code, steps, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: nonterminal -> nonterminal before it, initial of the role that follows. START is empty; conversations end in one of ENDS.
START, ENDS = "Start", ("Start", "Assistant")
GRAMMAR = [("System", "Start", "s"), ("User", "Start", "u"), ("User", "System", "u"), ("User", "Assistant", "u"), ("Assistant", "User", "a")]
#: Roles that reroling and inserting give.
GIVEN = {"u": "user", "a": "assistant"}
SYMBOLS = [START, *dict.fromkeys(left for left, _, _ in GRAMMAR)]
FOLLOWS = {s: [(left, t) for left, before, t in GRAMMAR if before == s] for s in SYMBOLS}
LEGAL = {"su", "ua", "au"}
SEGMENT, SEGMENT_BYTES, PREFIX = 1024, 4 << 20, 64

Column = dict[str, tuple[int, str]]


def _closed(items: Column) -> Column:
    """The column with all that insertions complete, least (cost, audit) first."""
    best: Column = {}
    agenda = [(cost, audit, symbol) for symbol, (cost, audit) in items.items()]
    heapq.heapify(agenda)
    while agenda:
        cost, audit, symbol = heapq.heappop(agenda)
        if symbol in best:
            continue
        best[symbol] = cost, audit
        for left, t in FOLLOWS[symbol]:  # predicted: left -> symbol . t
            if t in GIVEN and left not in best:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", left))
    return best


def _scanned(items: Column, initial: str, must_go: bool, truncated: bool) -> Column:
    """The next column before insertions: rows are kept or reroled by the terminal after a dot, or deleted."""
    after = {symbol: (cost + DELETE, audit + "D") for symbol, (cost, audit) in items.items()}
    if not must_go:
        for symbol, (cost, audit) in items.items():
            for left, t in FOLLOWS[symbol]:
                made = []
                if t == initial:
                    made.append((cost + KEEP + TRUNCATED * truncated, audit + "K"))
                if t in GIVEN:
                    made.append((cost + REROLE + TRUNCATED * truncated, audit + "R"))
                for value in made:
                    if left not in after or value < after[left]:
                        after[left] = value
    return after


def parse(rows: list[tuple[str, bool, bool, int]], before: str = START) -> Column:
    """The last column of the chart of rows (initial, must go, truncated, further copies) after a nonterminal."""
    column = _closed({before: (0, "")})
    for initial, must_go, truncated, more in rows:
        column = _scanned(column, initial, must_go, truncated)
        if more:
            column = {s: (cost + DELETE * more, audit + "D" * more) for s, (cost, audit) in column.items()}
        column = _closed(column)
    return column


def best_end(column: Column) -> tuple[int, str, str]:
    """Least cost and audit, and the nonterminal that they end in."""
    return min((*column[s], s) for s in ENDS if s in column)


def repaired(audit: str, before: str, rows: list[tuple[str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that an audit leaves, given rows (role, text, further copies) and what stands before."""
    symbol, at, copies = before, 0, 0
    for edit in audit:
        if edit == "I":
            symbol, t = next((left, t) for left, t in FOLLOWS[symbol] if t in GIVEN)
            yield edit, GIVEN[t], ""
            continue
        role, text, more = rows[at]
        if edit != "D":
            given = next((left, t) for left, t in FOLLOWS[symbol] if (t == role[:1] if edit == "K" else t in GIVEN))
            symbol = given[0]
            yield edit, role if edit == "K" else GIVEN[given[1]], text
        at, copies = (at + 1, 0) if copies == more else (at, copies + 1)


_VISIBLE = re.compile("[^\x20\x09-\x0d]")
_LAST = re.compile("([^\x20\x09-\x0d])[\x20\x09-\x0d]*\\Z")
_COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal"]


class _Segment:
    """Rows of one conversation, with what is counted over them."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.texts, self.bytes, self.count = conv_id, [], [], 0, dict.fromkeys(_COUNTS, 0)
        self.first = self.last = None
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn, role: str, text: str, copies: int, seen: bool) -> None:
        blank = not _VISIBLE.search(text)
        truncated = not blank and not seen and _LAST.search(text)[1] not in ".!?"
        c, initial = self.count, role[:1]
        c["rows"] += copies
        c["blank"] += copies if blank else 0
        c["duplicate"] += 0 if blank else copies if seen else copies - 1
        c["truncated"] += truncated
        c["illegal"] += (self.last is not None and self.last + initial not in LEGAL) + (copies - 1) * (2 * initial not in LEGAL)
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.first is None else self.first, initial
        self.rows.append((initial, blank or seen, truncated, copies - 1))
        self.texts.append((role, text, copies - 1))
        self.bytes += len(text)


_MOVE, _TURN = "struct<before:string,after:string,cost:long,audit:string>", "struct<role:string,text:string,more:long>"
#: A whole conversation has cost, audit and digest; a segment has moves and its rows.
_SEGMENTS = f"conv_id long, part int, seq int, {', '.join(f'{c} long' for c in _COUNTS)}, first string, last string, turns long, low long, high long, cost long, audit string, digest string, moves array<{_MOVE}>, texts array<{_TURN}>"


def _digest(lines: Iterator[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode()).hexdigest()


def _segments(keep_texts: bool):
    schema = to_arrow_schema(T.StructType.fromDDL(_SEGMENTS))

    def cut(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seq, held, out, size = 0, None, [], 0

        def record(s: _Segment, whole: bool) -> dict:
            nonlocal seq
            seq += 1
            row = {"conv_id": s.conv_id, "part": part, "seq": seq, **s.count, "first": s.first, "last": s.last, "turns": s.turns, "low": s.low, "high": s.high}
            if whole:
                cost, audit, _ = best_end(parse(s.rows))
                row |= {"cost": cost, "audit": audit, "digest": _digest(repaired(audit, START, s.texts))}
            else:
                row["moves"] = [{"before": b, "after": a, "cost": c, "audit": t} for b in SYMBOLS for a, (c, t) in parse(s.rows, b).items()]
            if keep_texts or not whole:
                row["texts"] = [{"role": r, "text": t, "more": m} for r, t, m in s.texts]
            return row

        begun = cut_off = False  # a conversation that may begin in an earlier task, or that was cut already, is not whole
        seen = None
        for batch in steps(batches, "text"):
            for conv_id, turn, role, text, digest, copies, is_row in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or conv_id != held.conv_id:
                    if held is not None:
                        out.append(record(held, begun and not cut_off))
                        size += held.bytes
                        begun = True
                    held, cut_off = _Segment(conv_id), False
                if not is_row:
                    seen = (conv_id, turn, role, digest)
                    continue
                if not copies:
                    continue  # a row that only names its conversation
                if len(held.rows) >= SEGMENT or held.bytes >= SEGMENT_BYTES:
                    out.append(record(held, False))
                    size += held.bytes
                    held, cut_off = _Segment(conv_id), True
                held.add(turn, role, text, copies, seen == (conv_id, turn, role, digest))
                if len(out) >= 1024 or size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if held is not None:
            out.append(record(held, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return cut


def segments(conversations: DataFrame, keep_texts: bool = True) -> DataFrame:
    """Parsed conversations and segments of conversations (conv_id long, turn long, role, text, copies: 0 for rows that only name
    their conversation), as a table in the shared folder. Whole conversations keep their texts only on request."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"))
    gone = F.col("copies") == 0
    rows = rows.select("conv_id", *[F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "text")], "copies")
    digest, head = F.md5("text").alias("digest"), F.substring("text", 1, PREFIX).alias("head")
    keys = rows.where("copies > 0").select("conv_id", "turn", "role", digest, head).distinct()
    # least turn of each role and text that stand in several turns; nulls first
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = keys.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("in"), F.col("role").alias("by"), F.col("digest").alias("of"), "first")
    later = keys.join(firsts, F.col("conv_id").eqNullSafe(F.col("in")) & (F.col("role") == F.col("by")) & (F.col("digest") == F.col("of"))).where(turn > F.col("first"))
    none = F.lit(None).cast("string").alias("text")
    marks = later.select("conv_id", "turn", "role", none, "digest", F.lit(0).cast("long").alias("copies"), F.lit(False).alias("is_row"), "head")
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    table = counted.select("conv_id", "turn", "role", "text", digest, "copies", F.lit(True).alias("is_row"), head).union(marks)
    by = ["conv_id", "turn", "role", "head", "digest"]
    ordered = table.repartitionByRange(*by).sortWithinPartitions(*by, "is_row").drop("head")
    return written(ordered.mapInArrow(_segments(keep_texts), _SEGMENTS))


_CHOSEN = "part int, seq int, begin string, chosen string, report struct<rows:long,blank:long,duplicate:long,truncated:long,illegal:long,gaps:long,cost:long>"


def _composed(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """What stands before each segment of one conversation and its edits; the report is in the last segment's row."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    total, last, high, low, turns = dict.fromkeys(_COUNTS, 0), None, None, None, 0
    column: dict[str, tuple] = {START: (0, "", ())}  # cost, audit, nonterminals before each segment
    for r in rows:
        for c in _COUNTS:
            total[c] += r[c]
        if r["first"] is not None:
            total["illegal"] += last is not None and last + r["first"] not in LEGAL
            last = r["last"]
        if r["low"] is not None:
            turns += r["turns"] - (r["low"] == high)
            low, high = r["low"] if low is None else low, r["high"]
        after: dict[str, tuple] = {}
        for m in r["moves"]:
            if m["before"] in column:
                cost, audit, path = column[m["before"]]
                value = cost + m["cost"], audit + m["audit"], (*path, m["before"])
                if m["after"] not in after or value < after[m["after"]]:
                    after[m["after"]] = value
        column = after
    cost, _, path, end = min((*column[s], s) for s in ENDS if s in column)
    total |= {"gaps": 0 if low is None else high - low + 1 - turns, "cost": cost}
    out = []
    for r, begin, after in zip(rows, path, [*path[1:], end]):
        chosen = next(m["audit"] for m in r["moves"] if (m["before"], m["after"]) == (begin, after))
        out.append({"part": r["part"], "seq": r["seq"], "begin": begin, "chosen": chosen, "report": total if r is rows[-1] else None})
    return pa.Table.from_pylist(out, schema)


def _opened(table: DataFrame) -> DataFrame:
    """Segments with what stands before them, their edits and, in the last of a conversation, its report."""
    parts, schema = table.where("moves is not null"), to_arrow_schema(T.StructType.fromDDL(_CHOSEN))

    def compose(key, rows):
        return _composed(rows, schema)

    chosen = parts.select("conv_id", "part", "seq", *_COUNTS, "first", "last", "turns", "low", "high", "moves").groupBy("conv_id").applyInArrow(compose, _CHOSEN)
    return parts.select("conv_id", "part", "seq", "texts").join(chosen, ["part", "seq"])


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _hashed(batches):
    """Reports of conversations from their segments in order."""
    sha, audit, begun = hashlib.sha256(), [], False
    for batch in batches:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            for _, role, text in repaired(r["chosen"], r["begin"], [(t["role"], t["text"], t["more"]) for t in r["texts"]]):
                sha.update((f"\n{role}:{text}" if begun else f"{role}:{text}").encode())
                begun = True
            audit.append(r["chosen"])
            if (end := r["report"]) is not None:
                row = [r["conv_id"], *(end[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), "".join(audit), sha.hexdigest()]
                names = [f.split()[0] for f in _REPORT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if type(v) is str else pa.int64()) for v in row], names)
                sha, audit, begun = hashlib.sha256(), [], False


def reports(table: DataFrame) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    gaps = F.expr("coalesce(high - low + 1 - turns, 0L)").alias("gaps")
    whole = table.where("moves is null").select("conv_id", gaps, *_COUNTS[1:], "cost", "audit", F.col("digest").alias("repaired_sha256"))
    opened = _opened(table).select("conv_id", "part", "seq", "begin", "chosen", "report", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.union(opened.mapInArrow(_hashed, _REPORT))


def turns(table: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, part, seq, turn, edit, role, text), in the order of part, seq and turn; from segments that keep texts."""

    def lay_out(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                lines = list(repaired(r["chosen"], r["begin"], [(t["role"], t["text"], t["more"]) for t in r["texts"]]))
                if lines:
                    same = [pa.array([r[c]] * len(lines), k) for c, k in (("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(lines)), pa.int32()), *(pa.array(list(x), pa.string()) for x in zip(*lines))], ["conv_id", "part", "seq", "turn", "edit", "role", "text"])

    whole = table.where("moves is null").select("conv_id", "part", "seq", "texts", F.lit(START).alias("begin"), F.col("audit").alias("chosen"))
    return whole.union(_opened(table).select(*whole.columns)).mapInArrow(lay_out, "conv_id long, part int, seq int, turn int, edit string, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows dropped, emptied, stripped of stops, repeated or given to the user by a checksum."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_code(spark)
    return reports(segments(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), keep_texts=False))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL: dict[str, str] = {}
