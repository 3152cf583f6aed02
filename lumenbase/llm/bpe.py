"""BPE encoding and decoding with a pair occurrence index.

Texts of a task are cut into pieces that no merge crosses; the distinct pieces that the task has not met yet are laid
out in one array of symbols with links to their neighbours. An index maps each mergeable pair to all its positions;
a heap holds the ranks that have positions. The lowest active rank is taken, all its positions are merged at once,
and the pairs that the merge makes with its neighbours are added to the lists of their own ranks. Ids equal those of
merging each piece alone, lowest rank first and leftmost first, because pieces do not touch.

Decoding looks up each id's bytes, joins them and reads them as UTF-8 with U+FFFD for what is not.

Defined results: null text encodes as an empty text: no ids, and an empty decoded text; repeated rows and equal or
null doc_ids each give their row; an empty table gives no rows; other columns are ignored. Special tokens written in a
text become their id, as with the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, kept, ragged
from .tokens import Coder, binaries, encoded, spaced

#: White space as Unicode has it; the pattern that byte-level vocabularies of this kind cut pieces with.
_SPACES = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
_NONE = np.int64(1) << 40


def byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = np.array([vocab[c] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order
        byte_of = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.token_size = np.array([len(b) for b in spelled], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it does not merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has, by the pair occurrence index."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        symbol = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        after[ends[sizes > 0] - 1] = n
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n + 1, _NONE)  # of the pair that begins at a position; one more for "no position"
        inner = np.flatnonzero(after < n)
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def listed(positions: np.ndarray) -> None:
            positions = positions[rank[positions] != _NONE]
            if not len(positions):
                return
            own = rank[positions]
            order = np.argsort(own, kind="stable")
            positions, own = positions[order], own[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for r, group in zip(own[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(heap, r)

        listed(inner)
        while heap:
            r = heapq.heappop(heap)
            groups = index.pop(r)
            left = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            left = left[alive[left] & (rank[left] == r)]
            if not len(left):
                continue
            right = after[left]
            if symbol[left[0]] == symbol[right[0]]:  # runs like aaa: every other position from the left
                left = np.sort(left)
                right = after[left]
                chained = np.concatenate([[False], right[:-1] == left[1:]])
                at = np.arange(len(left))
                head = np.maximum.accumulate(np.where(chained, 0, at))
                left = left[(at - head) % 2 == 0]
                right = after[left]
            symbol[left] = self.result[r]
            alive[right] = False
            rank[right] = _NONE
            beyond = after[right]
            after[left] = beyond
            inside = beyond < n
            before[beyond[inside]] = left[inside]
            rank[left] = _NONE
            if inside.any():
                a = left[inside]
                rank[a] = self.ranks(symbol[a], symbol[after[a]])
            prior = before[left]
            prior = prior[prior >= 0]
            if len(prior):
                rank[prior] = self.ranks(symbol[prior], symbol[after[prior]])
            listed(np.unique(np.concatenate([left, prior])))
        total = np.concatenate([[0], np.cumsum(alive)])
        return symbol[alive], total[ends] - total[ends - sizes]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each row's ids."""
        size = self.token_size[ids]
        raw = self.token_bytes[ragged(self.token_start[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _vocabulary(path: str) -> tuple[Merges, Coder]:
    """One vocabulary and chunk memory for each worker process and stage."""
    import regex

    merges, cut = kept(f"merges {path}", lambda: Merges(path)), regex.compile(_PIECES)

    def encode_chunks(chunks: list) -> tuple[np.ndarray, np.ndarray]:
        parts = [cut.findall(c) for c in spaced(chunks)]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(p for ps in parts for p in ps))}
        ids, counts = merges.encode([p.encode() for p in distinct])
        number = np.array([distinct[p] for ps in parts for p in ps], np.int64)
        starts = np.cumsum(counts) - counts
        flat = ids[ragged(starts[number], counts[number])]
        ends = np.concatenate([[0], np.cumsum(counts[number])])[np.concatenate([[0], np.cumsum([len(p) for p in parts])])]
        return flat, np.diff(ends)

    return merges, kept(f"pieces {path}", lambda: Coder(encode_chunks, True, merges.special))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch, ids, counts in encoded(batches, _vocabulary(tokenizer)[1]):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), binaries(ids.astype("<u4"), counts)], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded_docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded)."""

    def run(batches):
        merges = _vocabulary(tokenizer)[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts = np.asarray(part.column(1)).astype(np.int64)
                ids = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(merges.decode(ids, counts), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded_docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so ids never leave the task."""

    def run(batches):
        merges, coder = _vocabulary(tokenizer)
        for batch, ids, counts in encoded(batches, coder):
            raw, ends = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts) * 4]).tolist()
            shas = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in merges.decode(ids.astype(np.int64), counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(shas), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE_SQL: dict[str, str] = {}
