"""Tokenizing whole texts inside a task: texts fall into chunks that a tokenizer treats alone, and
each distinct chunk is encoded once.

A chunk boundary is a place no token can cross, so the ids equal those of the whole text:
byte-level vocabularies split before a space, and around a line feed, that a visible character follows; vocabularies
that drop white space split at ASCII white space. Special tokens written in a text are cut out first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import STEP_BYTES, kept, ragged, steps

#: Beyond so many chunks, or bytes in them, a coder keeps only those met most often, up to half as many.
MOST_CHUNKS, MOST_BYTES = 700_000, 16 << 20
#: Marks of a chunk that no space precedes and of a line feed (alone) or of a chunk that begins with a mark.
_FIRST, _LINE = "\x00", "\x01"
#: What keeps a text from being split at each space and line feed: white space or the end after one, or a mark.
_ODD = r"[ \n](?:[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)|[\x00\x01]"


class Coder:
    """``encode_chunks(list of chunks) -> (flat ids, counts)`` applied to each distinct chunk once.

    Chunks are remembered as one Arrow array, a few dozen bytes each, in which Arrow looks up the distinct chunks of a step."""

    def __init__(self, encode_chunks: Callable, spaced: bool, special: dict[str, int] | None = None):
        self.encode_chunks, self.spaced, self.special = encode_chunks, spaced, special or {}
        self.pattern = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if self.special else None
        self.known = pa.array([], pa.large_string())
        self.flat, self.start, self.size, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the chunks met at least twice, at most half of what is allowed; how often they were met counts half."""
        keep = np.flatnonzero(self.met >= 2)
        if len(keep) > MOST_CHUNKS // 2:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[: MOST_CHUNKS // 2]])
        known = self.known.take(pa.array(keep))
        if (pc.sum(pc.binary_length(known)).as_py() or 0) > MOST_BYTES // 2:
            keep, known = keep[:0], known[:0]
        self.known = known
        self.flat = self.flat[ragged(self.start[keep], self.size[keep])]
        self.size = self.size[keep]
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.met = self.met[keep] // 2

    def _found(self, chunks: pa.Array) -> np.ndarray:
        """The numbers of distinct chunks; those not met before are encoded."""
        number = pc.index_in(chunks, value_set=self.known)
        if number.null_count:
            unseen = chunks.filter(number.is_null())
            texts = unseen.to_pylist()
            if self.spaced:
                texts = [c if c[:1] > _LINE else (c[1:],) if c[:1] == _FIRST else ("\n",) if c == _LINE else c[1:] for c in texts]
            ids, counts = self.encode_chunks(texts)
            ends = np.cumsum(counts) + len(self.flat)
            first = len(self.known)
            self.known = pa.concat_arrays([self.known, unseen])
            self.start, self.size = np.concatenate([self.start, ends - counts]), np.concatenate([self.size, counts.astype(np.int32)])
            self.flat, self.met = np.concatenate([self.flat, ids.astype(np.uint32)]), np.concatenate([self.met, np.zeros(len(counts), np.int32)])
            own = np.flatnonzero(np.asarray(number.is_null()))
            number = np.asarray(number.fill_null(0)).astype(np.int64)
            number[own] = first + np.arange(len(own))
            return number
        return np.asarray(number).astype(np.int64)

    def _chunks(self, text: str) -> list:
        """One text's chunks as they are remembered; special tokens as their ids."""
        found: list = []
        for part in self.pattern.split(text) if self.pattern else [text]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found += [_FIRST + c[0] if type(c) is tuple else c if c[:1] > _LINE else _LINE + c for c in split_spaces(part)]
        return found

    def _numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks in order, special tokens as -1 - id, and how many each text has.

        Arrow splits the texts and finds the distinct chunks of the step, so Python meets each of those once. Texts with
        special tokens, marks, or runs of white space are split in Python.
        """
        if not self.spaced:
            chunks, odd = pc.ascii_split_whitespace(texts), np.zeros(len(texts), bool)
        else:
            odd = pc.match_substring_regex(texts, _ODD)
            for token in self.special:
                odd = pc.or_(odd, pc.match_substring(texts, token))
            odd = odd.to_numpy(zero_copy_only=False)
            marked = pc.binary_join_element_wise(pa.scalar(_FIRST, texts.type), texts.filter(pa.array(~odd)) if odd.any() else texts, pa.scalar("", texts.type))
            chunks = pc.split_pattern(pc.replace_substring(marked, "\n", f" {_LINE} {_FIRST}"), " ")
        distinct = chunks.flatten().dictionary_encode()
        found = self._found(distinct.dictionary)[distinct.indices.to_numpy()]
        counts = pc.list_value_length(chunks).to_numpy().astype(np.int64)
        if not odd.any():
            return found, counts
        others = {i: self._chunks(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        words = list(dict.fromkeys(c for own in others.values() for c in own if type(c) is str))
        number = dict(zip(words, self._found(pa.array(words, pa.large_string())).tolist()))
        per_text = np.zeros(len(texts), np.int64)
        per_text[~odd] = counts
        per_text[odd] = [len(o) for o in others.values()]
        starts = np.cumsum(per_text) - per_text
        numbers = np.empty(int(per_text.sum()), np.int64)
        numbers[ragged(starts[~odd], counts)] = found
        for i, own in others.items():
            numbers[starts[i] : starts[i] + len(own)] = [number[c] if type(c) is str else -1 - c for c in own]
        return numbers, per_text

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has; null is empty."""
        if len(self.known) > MOST_CHUNKS or self.known.nbytes > MOST_BYTES + 8 * MOST_CHUNKS:
            self._forget()
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        numbers, per_text = self._numbers(texts)
        cut = np.flatnonzero(numbers < 0)
        if len(self.size):
            chunk = np.maximum(numbers, 0)
            self.met += np.bincount(chunk, minlength=len(self.size)).astype(np.int32)
            starts, sizes = self.start[chunk], self.size[chunk].astype(np.int64)
        else:
            starts, sizes = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        sizes[cut] = 1
        starts[cut] = 0
        where = ragged(starts, sizes)
        ids = self.flat[where] if len(self.flat) else np.zeros(len(where), np.uint32)
        ends = np.cumsum(sizes)
        ids[ends[cut] - 1] = (-1 - numbers[cut]).astype(np.uint32)
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(before)


_SPACE = re.compile(r" (?=\S)")


def split_spaces(text: str) -> list:
    """Chunks of a byte-level vocabulary, each without the space that it begins with; the first, which has none, in a tuple."""
    parts = _SPACE.split(text)
    if parts[0]:
        parts[0] = (parts[0],)
        return parts
    return parts[1:]


def spaced(chunks: list) -> list[str]:
    """The texts of such chunks."""
    return [c[0] if type(c) is tuple else " " + c for c in chunks]


#: A word of Latin-1 letters, alone or with ASCII marks after: one piece each, which need no normalization.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]{0,8})")
#: So many runs of marks are remembered.
MOST_MARKS = 10_000
#: How byte-level vocabularies write the two UTF-8 bytes of U+00C0 to U+00FF: bytes from 0xA1 stand for themselves
#: (but 0xAD), those from 0x80 to 0xA0 for U+0122 on.
_BYTE_CHARS = {c: "".join(chr(b) if b > 0xA0 and b != 0xAD else "\u0143" if b == 0xAD else chr(0x122 + b - 0x80) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def library_coder(path: str) -> Coder:
    """A coder on the tokenizers library; ids as ``encode(text, add_special_tokens=False)`` gives."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    drops_space = tokenizer.normalizer is not None

    tokenize = tokenizer.model.tokenize
    marks: dict[str, list[int]] = {"": []}

    def encode_chunks(chunks: list) -> tuple[np.ndarray, np.ndarray]:
        found, rest = [], []
        words: dict[str, list[int]] = {}
        if len(marks) > MOST_MARKS:
            marks.clear()
        plain, begin = _PLAIN.fullmatch, "" if drops_space else "\u0120"
        for i, chunk in enumerate(chunks):
            match = plain(chunk) if type(chunk) is str else plain(chunk[0])
            if match is None:
                rest.append(i)
                found.append(())
                continue
            word, mark = match.groups()
            piece = word.lower() if drops_space else begin + word if type(chunk) is str else word
            if (ids := words.get(piece)) is None:  # one word is one piece: straight to the merges
                ids = words[piece] = [t.id for t in tokenize(piece if word.isascii() else piece.translate(_BYTE_CHARS))]
            if mark:
                if mark not in marks:
                    marks[mark] = [t.id for t in tokenize(mark)]
                ids = ids + marks[mark]
            found.append(ids)
        others = [chunks[i] for i in rest]
        for i, encoding in zip(rest, tokenizer.encode_batch_fast(others if drops_space else spaced(others), add_special_tokens=False)):
            found[i] = encoding.ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    special = {} if drops_space else {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    return Coder(encode_chunks, not drops_space, special)


def library_coder_of(path: str) -> Coder:
    """One coder for each worker process and stage; its chunks serve later tasks."""
    return kept(f"coder {path}", lambda: library_coder(path))


def encoded(batches: Iterable[pa.RecordBatch], coder: Coder, text: str = "text", step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with all their ids and the count of each row; null is empty."""
    for batch in steps(batches, text, step):
        yield batch, *coder.encode(batch.column(batch.schema.get_field_index(text)))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each row's ids."""
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    ends = np.cumsum(counts + 1) - 1
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own] = ids
    return out, counts + 1


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column with the bytes of ``counts[i]`` values in row i."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def token_table(docs, path: str, end_id: int, step: int = STEP_BYTES):
    """(part, local_start, doc_id, n_tokens, ids, counts) of every document, in scan order, as a table in the shared folder.

    ``part`` is the task that read the document and ``local_start`` counts the ids before it in that task; ids are
    little-endian unsigned 16- or 32-bit integers, whichever ``id_type`` says for the vocabulary. ``counts`` is null but in
    one row more for each task, without a document: how often each id occurs in the task, as 64-bit integers.
    """
    from .common import written

    width = id_type(path)

    def tokenize(batches):
        from pyspark import TaskContext

        part, at, totals = TaskContext.get().partitionId(), 0, np.zeros(1 << 16, np.int64)
        names = ["part", "local_start", "doc_id", "n_tokens", "ids", "counts"]
        for batch, ids, counts in encoded(batches, library_coder_of(path), step=step):
            ids, counts = with_end(ids, counts, end_id)
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            met = np.bincount(ids)
            if len(met) > len(totals):
                totals = np.pad(totals, (0, len(met) - len(totals)))
            totals[: len(met)] += met
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), part, np.int32)), pa.array(starts), batch.column(0), pa.array(counts), binaries(ids.astype(width), counts), pa.nulls(len(counts), pa.binary())], names)
        end = [pa.array([part], pa.int32()), pa.array([at]), pa.nulls(1, pa.int64()), pa.array([0]), pa.array([b""]), pa.array([np.trim_zeros(totals, "b").tobytes()])]
        yield pa.RecordBatch.from_arrays(end, names)

    return written(docs.select("doc_id", "text").mapInArrow(tokenize, "part int, local_start long, doc_id long, n_tokens long, ids binary, counts binary"))


def id_type(path: str) -> str:
    """'<u2' if all ids of the vocabulary fit, else '<u4'."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


def part_bases(table):
    """(part, base): ids in all parts before; one row for each task that made a part, so small enough to broadcast."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
