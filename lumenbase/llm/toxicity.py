"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word's input is a hashed word embedding plus the scaled sum of its hashed character n-gram embeddings (3 to 5, with ends). Windows of
``WINDOW`` words that overlap by half cover the whole text; in each, two gated recurrent units read the words forward
and backward, attention pools their states, and a linear layer gives a logit. A text's logit is the mean of its
``TOP`` highest windows (of all, if fewer), so that one chance likeness does not condemn a long text. Training, in numpy on the
driver, sees whole texts of at most ``TOXIC + CLEAN`` labelled documents and at most ``MOST_FIT`` characters of them in all (those
with the smallest hashes, of each label). A text's windows are dealt to the epochs in turn, at least ``PER_EPOCH`` to each, so all
are seen; the document's label trains the windows that make its logit, so toxic ones need no marking. Scoring runs in Arrow batches over all windows of all documents.

Defined results: null or empty text scores as no evidence (the output bias); repeated rows score alike but for rounding; with no
labelled document to learn from, or labels of one kind only, every score is that kind's share (0 without labels); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, ragged, steps

WINDOW, STRIDE, THRESHOLD = 32, 16, 0.7
TOP, TOXIC, CLEAN, MOST_FIT, PER_EPOCH, EPOCHS, BATCH, RATE, DECAY = 4, 700, 900, 32 << 20, 8, 4, 48, 0.02, 0.05
WORD_SLOTS, CHAR_SLOTS, INPUT, HIDDEN, ATTENTION = 1 << 14, 1 << 15, 16, 8, 8
#: Words that a worker remembers the inputs of.
MOST_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    return [w.strip(".,;:!?\"'()[]") for w in text.lower().split()] if text else []


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; the last ends with the text."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else [0]


def _slots(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slot of each, character slots of all (n-grams of its UTF-8 bytes), and how many each word has."""
    raw = [w.encode() for w in words]
    own = np.array([zlib.crc32(w) % WORD_SLOTS for w in raw], np.int64)
    spelled = [b"<%b>" % (w or b"_") for w in raw]
    size = np.fromiter(map(len, spelled), np.int64, len(spelled))
    letters = np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(spelled)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(letters))  # letters up to the word's end
    rows, slots = [], []
    code = np.zeros(len(letters), np.uint64)
    for n in range(1, 6):
        code = code[: len(letters) - n + 1] * np.uint64(0x100000001B3) + letters[n - 1 :]
        if n >= 3:
            whole = left[: len(code)] >= n
            mixed = (code[whole] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            rows.append(row[: len(code)][whole])
            slots.append((mixed >> np.uint64(40)).astype(np.int64) % CHAR_SLOTS)
    rows, slots = np.concatenate(rows), np.concatenate(slots)
    return own, slots[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(spelled))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _highest(logit: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The TOP highest windows of each group, and one over how many there are."""
    order = np.lexsort((-logit, group))
    counts = np.bincount(group, minlength=groups)
    place = np.arange(len(order)) - (np.cumsum(counts) - counts)[group[order]]
    chosen = order[place < TOP]
    return chosen, 1.0 / np.minimum(counts, TOP)[group[chosen]]


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(WORD_SLOTS, INPUT, scale=0.02), "char": normal(CHAR_SLOTS, INPUT, scale=0.02)}
        for d in "fb":
            self.p |= {f"W{d}": normal(INPUT, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3)}
        self.p |= {"A": normal(2 * HIDDEN, ATTENTION, scale=0.3), "v": normal(ATTENTION, scale=0.5), "o": normal(2 * HIDDEN, scale=0.3), "bias": np.array([-2.0], np.float32)}

    def inputs(self, own: np.ndarray, chars: np.ndarray, sizes: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """Each word's input vector; ``keep`` masks word embeddings while training."""
        chars_in = np.add.reduceat(self.p["char"][chars], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None] if len(own) else np.zeros((0, INPUT), np.float32)
        word = self.p["word"][own]
        return (chars_in + (word if keep is None else word * keep[:, None])).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs, side by side."""
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"], axis=1)

    def _read(self, d: str, x: np.ndarray, mask: np.ndarray | None, trace: list | None) -> np.ndarray:
        """States of one direction: x is (windows, words, 3 * HIDDEN)."""
        u, h = self.p[f"U{d}"], np.zeros((len(x), HIDDEN), np.float32)
        states = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            g, a = x[:, t], h @ u
            rz = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            r, z, c = rz[:, :HIDDEN], rz[:, HIDDEN:], a[:, 2 * HIDDEN :]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * c)
            after = n + z * (h - n)
            if mask is not None:
                after = np.where(mask[:, t, None], after, h)
            if trace is not None:
                trace.append((t, h, r, z, c, n))
            states[:, t] = h = after
        return states

    def forward(self, x: np.ndarray, mask: np.ndarray | None = None, trace: dict | None = None) -> np.ndarray:
        """Logits of windows: x is (windows, words, 6 * HIDDEN)."""
        tf, tb = ([], []) if trace is not None else (None, None)
        h = np.concatenate([self._read("f", x[:, :, : 3 * HIDDEN], mask, tf), self._read("b", x[:, :, 3 * HIDDEN :], mask, tb)], axis=2)
        u = np.tanh(h @ self.p["A"])
        s = u @ self.p["v"]
        if mask is not None:
            s = np.where(mask, s, -30)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        if mask is not None:
            e = e * mask
        a = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-30)
        pooled = (a[:, None, :] @ h)[:, 0]
        if trace is not None:
            trace |= {"f": tf, "b": tb, "h": h, "u": u, "a": a, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["bias"][0]

    def backward(self, dlogit: np.ndarray, mask: np.ndarray, k: dict) -> tuple[np.ndarray, dict]:
        """Gradients of the gate inputs and of the weights."""
        p, h, a, u = self.p, k["h"], k["a"], k["u"]
        g = {"o": k["pooled"].T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * p["o"]
        da = (h @ dpooled[:, :, None])[:, :, 0]
        ds = a * (da - (da * a).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("wt,wta->a", ds, u)
        du = ds[:, :, None] * p["v"] * (1 - u * u)
        g["A"] = np.einsum("wth,wta->ha", h, du)
        dh = a[:, :, None] * dpooled[:, None, :] + du @ p["A"].T
        dx = np.empty((len(h), h.shape[1], 6 * HIDDEN), np.float32)
        for d, at in (("f", 0), ("b", 1)):
            w, du_, carry = p[f"U{d}"], np.zeros_like(p[f"U{d}"]), np.zeros((len(h), HIDDEN), np.float32)
            for t, before, r, z, c, n in reversed(k[d]):
                full = carry + dh[:, t, at * HIDDEN : (at + 1) * HIDDEN]
                live = full * mask[:, t, None]
                dn = live * (1 - z) * (1 - n * n)
                pre = np.concatenate([dn * c * r * (1 - r), live * (before - n) * z * (1 - z), dn * r], axis=1)
                du_ += before.T @ pre
                carry = full - live + live * z + pre @ w.T
                dx[:, t, at * 3 * HIDDEN : (at + 1) * 3 * HIDDEN] = np.concatenate([pre[:, : 2 * HIDDEN], dn], axis=1)
            g[f"U{d}"] = du_
        return dx, g


def dealt(n: int, epoch: int) -> slice:
    """Which of n windows an epoch sees: every k-th, so that the epochs together see all, and at least PER_EPOCH if there are as many."""
    k = max(1, min(EPOCHS, n // PER_EPOCH))
    return slice(epoch % k, None, k)


def train(samples: list[list[str]], toxic: list[int], seed: int = 7) -> Network:
    """samples: the words of each document, at least one."""
    net, rng = Network(seed), np.random.default_rng(seed)
    vocabulary = {w: i for i, w in enumerate(sorted({w for doc in samples for w in doc}))}
    own, chars, sizes = _slots(list(vocabulary))
    starts = np.cumsum(sizes) - sizes
    docs = []
    for doc in samples:
        numbers, at = np.array([vocabulary[w] for w in doc], np.int32), np.array(window_starts(len(doc)))[:, None] + np.arange(WINDOW)
        docs.append((numbers[np.minimum(at, len(doc) - 1)] * (at < len(doc)), at < len(doc)))
    labels = np.array(toxic, np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            ids, mask = (np.concatenate([docs[i][j][dealt(len(docs[i][0]), epoch)] for i in pick]) for j in (0, 1))
            counts = np.array([len(docs[i][0][dealt(len(docs[i][0]), epoch)]) for i in pick])
            used, inverse = np.unique(ids, return_inverse=True)
            inverse = inverse.reshape(ids.shape)
            grams = chars[ragged(starts[used], sizes[used])]
            keep = (rng.random(len(used)) < 0.5).astype(np.float32) * 2
            x = net.inputs(own[used], grams, sizes[used], keep)
            trace: dict = {}
            logit = net.forward(net.gates(x)[inverse], mask, trace)
            group = np.repeat(np.arange(len(pick)), counts)
            chosen, share = _highest(logit, group, len(pick))
            doc_logit = np.bincount(group[chosen], logit[chosen] * share, len(pick))
            error = (_sigmoid(doc_logit) - labels[pick]) / len(pick)
            dlogit = np.zeros(len(logit), np.float32)
            dlogit[chosen] = error[group[chosen]] * share
            dx, g = net.backward(dlogit, mask, trace)
            flat = np.zeros((len(used), 6 * HIDDEN), np.float32)
            np.add.at(flat, inverse.reshape(-1), dx.reshape(-1, 6 * HIDDEN))
            dinput = np.zeros_like(x)
            for d, cut in (("f", slice(0, 3 * HIDDEN)), ("b", slice(3 * HIDDEN, None))):
                g[f"W{d}"], g[f"c{d}"] = x.T @ flat[:, cut], flat[:, cut].sum(axis=0)
                dinput += flat[:, cut] @ net.p[f"W{d}"].T
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], own[used], dinput * keep[:, None])
            np.add.at(g["char"], grams, np.repeat(dinput / np.sqrt(sizes[used])[:, None], sizes[used], axis=0))
            step += 1
            rate = RATE * (1 - 0.8 * epoch / EPOCHS)
            for key, grad in g.items():
                m[key] += 0.1 * (grad - m[key])
                v[key] += 0.01 * (grad * grad - v[key])
                if key in ("word", "char"):  # what is rarely met shrinks towards no evidence
                    net.p[key] *= 1 - rate * DECAY
                net.p[key] -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-7)
    return net


class Scorer:
    """Scores texts; keeps the gate inputs of words that it has met."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MOST_WORDS:
            self._forget()
        known, unseen, numbers, counts = self.known, [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = words_of(text)
            counts[i] = len(words)
            for w in words:
                n = known.get(w)
                if n is None:
                    known[w] = n = len(known)
                    unseen.append(w)
                numbers.append(n)
        for at in range(0, len(unseen), 1 << 14):
            self.table = np.concatenate([self.table, self.net.gates(self.net.inputs(*_slots(unseen[at : at + (1 << 14)])))])
        return np.array(numbers, np.int64), counts

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        numbers, counts = self._numbers(texts)
        begins = np.cumsum(counts) - counts
        lots = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, 0)
        row = np.repeat(np.arange(len(texts)), lots)
        start = np.minimum(ragged(np.zeros(len(lots), np.int64), lots) * STRIDE, (counts - WINDOW)[row]) + begins[row]
        logit = np.zeros(len(row), np.float32)
        for at in range(0, len(row), 2048):
            logit[at : at + 2048] = self.net.forward(self.table[numbers[start[at : at + 2048, None] + np.arange(WINDOW)]])
        chosen, share = _highest(logit, row, len(texts))
        pooled = np.bincount(row[chosen], logit[chosen] * share, len(texts)) if len(row) else np.zeros(len(texts))
        short = np.flatnonzero((counts > 0) & (counts <= WINDOW))
        for at in range(0, len(short), 2048):
            pick = short[at : at + 2048]
            mask = np.arange(WINDOW) < counts[pick][:, None]
            ids = numbers[np.where(mask, begins[pick][:, None] + np.arange(WINDOW), begins[pick][:, None])]
            pooled[pick] = self.net.forward(self.table[ids], mask)
        pooled[counts == 0] = self.net.p["bias"][0]
        return _sigmoid(pooled)


def _training_texts(docs: DataFrame, labels: DataFrame) -> list:
    """Rows (doc_id, toxic, text) of the sampled documents."""
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picks = [known.where(f"toxic = {kind}").select("doc_id", "toxic").distinct().orderBy(*order).limit(n) for kind, n in ((1, TOXIC), (0, CLEAN))]
    sample = F.broadcast(picks[0].union(picks[1]))  # at most TOXIC + CLEAN rows
    joined = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    sizes = joined.select("doc_id", "toxic", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    # repeated rows count once each; a bounded table, so one task may sum it up
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(*order))
    kept = sizes.withColumn("upto", upto).where(F.col("upto") <= MOST_FIT // 2).select("doc_id").distinct()
    return joined.join(F.broadcast(kept), "doc_id").select("doc_id", "toxic", "text").collect()


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = sorted(((r["doc_id"], r["toxic"], words_of(r["text"])) for r in _training_texts(docs, labels)))
    rows = [r for r in rows if any(r[2])]
    kinds = {toxic for _, toxic, _ in rows}
    spark = docs.sparkSession
    if kinds == {0, 1}:
        net = train([words for _, _, words in rows], [toxic for _, toxic, _ in rows])
        shared = spark.sparkContext.broadcast(net.p)
    else:
        shared = spark.sparkContext.broadcast(float(1 in kinds))

    def score(batches):
        scorer = None
        for batch in steps(batches, "text", 2 << 20):
            texts = batch.column(1).to_pylist()
            if isinstance(shared.value, float):
                scores = np.full(len(texts), shared.value)
            else:
                if scorer is None:
                    net = Network.__new__(Network)
                    net.p = shared.value
                    scorer = Scorer(net)
                scores = scorer(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(np.float64))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
