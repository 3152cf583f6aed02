"""Plain programs that say what the operators must return."""

import hashlib
import re
import struct
import zlib

import numpy as np
import xxhash

BLANKS = " \t\n\x0b\x0c\r"
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def classes(items, linked):
    """Smallest reachable item of each, by index pairs."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        if items[a] > items[b]:
            a, b = b, a
        parent[b] = a
    return [items[find(i)] for i in range(len(items))]


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    spots = {}
    for i in range(len(w) - 7):
        spots.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {k for p in spots.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def fingerprint(text):
    w = words((text or "").translate(FOLD))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], ">u8").view(np.uint8).reshape(-1, 8)
    return int(np.packbits(2 * np.unpackbits(h, axis=1).astype(int).sum(0) > len(shingles)).view(">u8")[0])


def simhash(rows):
    """rows: (doc_id, text); {(doc_id, fingerprint, component_id)} as a list."""
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    pairs = [(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 2)]
    return [(d, format(int(p), "016x"), c) for (d, _), p, c in zip(rows, prints, classes([d for d, _ in rows], pairs))]


def line_dedup(rows):
    key = lambda line: line.strip(BLANKS).translate(FOLD)
    held = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(d)
    keeper = {k: max(ds) for k, ds in held.items() if len(set(ds)) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def substring_dedup(rows):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(i, i + 50)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def vectors(rows, least=0.95):
    """rows: (vec_id, components or None)."""
    good = [(i, np.array(v, np.float64)) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, pairs = {i: 0 for i in range(len(rows))}, []
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    return [(d, links[i], c) for i, ((d, _), c) in enumerate(zip(rows, classes([d for d, _ in rows], pairs)))]
