"""Text operators against plain programs: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenbase.llm import bloom, bpe, components, line_dedup, packing, quality, simhash, substring_dedup, token_file, tokens, toxicity
from lumenbase.llm.common import scratch

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def twice(docs):
    """Some rows repeated."""
    return docs.union(docs.where("doc_id % 4 = 0"))


def repeated(rows):
    return rows + [r for r in rows if r[0] % 4 == 0]


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_quality(docs, rows, none):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert found(quality.quality_rules(twice(docs)), *names) == sorted(((d, *brute.quality(t)) for d, t in repeated(rows)), key=repr)
    out = quality.quality_rules(docs)
    assert out.where("base_failed and kept").count() == 0 and out.where("kept is null").count() == 0
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and found(kept, "doc_id") == found(out.where("kept"), "doc_id")
    assert quality.quality_rules(none).count() == 0


def test_quality_keeps_labelled(spark):
    folder = "/root/testdata/sf0.01"
    plan = quality.op3_quality_rules(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    out = quality.op3_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("not kept").count() == 0 and bad.where("kept").count() <= 0.05 * bad.count()


def test_line_dedup(docs, rows, none):
    out = line_dedup.line_dedup(twice(docs))
    assert found(out, "doc_id", "n_lines", "n_dropped", "text") == sorted(brute.line_dedup(repeated(rows)), key=repr)
    assert set(docs.columns) <= set(out.columns) and out.where("key <> 'clash'").count() == 0
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_beyond_broadcast_bounds(docs, rows, monkeypatch):
    """Suspects found by a shuffle of bit numbers, lost keys joined with their documents."""
    monkeypatch.setattr(line_dedup, "MOST_SHARED", 0)
    monkeypatch.setattr(bloom, "MOST_MARKS", 0)
    assert found(line_dedup.line_dedup(docs), "doc_id", "n_lines", "n_dropped", "text") == sorted(brute.line_dedup(rows), key=repr)


def test_line_dedup_counts_documents(spark):
    """Repeated rows count once; rows without a doc_id neither count nor lose lines."""
    line = "a line that several documents hold, more than forty characters of it"
    rows = [(1, line), (1, line), (2, line), (3, line), (4, line), (None, line), (None, line)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.line_dedup(make(rows)).where("n_dropped > 0").count() == 0
    out = found(line_dedup.line_dedup(make([*rows, (5, line)])), "doc_id", "n_dropped")
    assert out == sorted([(d, int(d is not None and d < 5)) for d, _ in [*rows, (5, line)]], key=repr)


@pytest.mark.parametrize("bits", [1, 20])
def test_filter_load(spark, monkeypatch, bits):
    """At the size that is chosen few unique hashes are suspected; at a twentieth of it more, and none is missed either way."""
    monkeypatch.setattr(bloom, "BITS_PER_KEY", bits)
    rng = np.random.default_rng(3)
    unique, again = rng.integers(-(1 << 63), 1 << 63, 20000), rng.integers(-(1 << 63), 1 << 63, 300)
    keys = spark.createDataFrame([(int(h), 0, [1]) for h in [*unique, *again, *again]], "h1 long, h2 long, ids array<long>").repartition(6)
    segments = bloom.segments_for(20300)
    out = {r["h1"] for r in bloom.suspected(keys, "h1", line_dedup.seen_twice(keys, segments), segments).collect()}
    assert out >= set(again.tolist())
    false = len(out - set(again.tolist())) / len(unique)
    assert false < 0.02 if bits == 20 else false > 0.1


def test_clashing_names_keep_their_values(docs, rows):
    """Columns named like those inside, with dots and with blanks, pass through every operator that passes columns."""
    import corpus_pipeline

    names = ["firsts", "lasts", "lost", "a.b", "n words", "n_words", "n_lines", "n_removed", "kept_text", "loser", "h1", "mark", "first_id"]
    wide = docs.select("doc_id", "text", *[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names])
    mine = lambda df, own: found(df.select("doc_id", *[f"`{n}`" for n in names if n not in own]), "*")
    for out, own in ((line_dedup.line_dedup(wide), ("n_lines",)), (substring_dedup.substring_dedup(wide), ("n_words", "n_removed", "kept_text"))):
        assert mine(out, own) == mine(wide, own)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(docs.sparkSession, wide, "")
        assert out.columns == wide.columns and out.where(" or ".join(f"`{n}` <> concat('{n} of ', doc_id)" for n in names)).count() == 0


def test_substring_dedup(docs, rows, none):
    want = sorted(brute.substring_dedup(repeated(rows)), key=repr)
    assert sum(w[2] for w in want) > 400
    for batches in (1, 2, 5):
        out = substring_dedup.substring_dedup(twice(docs), batches)
        assert found(out, "doc_id", "n_words", "n_removed", "kept_text") == want
    assert substring_dedup.substring_dedup(none).count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert substring_dedup.substring_dedup(nulls).where("n_removed > 0").count() == 0


def test_substring_beyond_broadcast_bounds(docs, rows, monkeypatch):
    """Copies that no task skips, stretches joined by a shuffle, suspected grams beside each text instead of a filter."""
    for name in ("MOST_COPIES", "MOST_LOSERS"):
        monkeypatch.setattr(substring_dedup, name, 0)
    monkeypatch.setattr(bloom, "MOST_MARKS", 0)
    out = substring_dedup.substring_dedup(docs, 3)
    assert found(out, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.substring_dedup(rows), key=repr)


def test_substring_index_in_later_calls(spark, docs, rows):
    """Three batches, each by an index that opens the folder anew; the third joins the compacted run of the first two."""
    folder, lost = scratch(spark), []
    edges = [0, 22, 40, 10**6]
    for low, high in zip(edges, edges[1:]):
        index = substring_dedup.FingerprintIndex(spark, folder)
        lost.append(index.add(docs.where(f"doc_id >= {low} and doc_id < {high}"), docs))
    assert [r["level"] for r in substring_dedup.FingerprintIndex(spark, folder).state["runs"]] == [1, 0]
    out = substring_dedup.without_windows(docs, substring_dedup._union(lost))
    assert found(out.select(*[f"c{i}" for i in (0,)], "n_words", "n_removed", "kept_text"), "c0", "n_words", "n_removed", "kept_text") == sorted(brute.substring_dedup(rows), key=repr)
    index.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("run_")]


@pytest.mark.parametrize("most", [0, 10**6])
def test_substring_index_takes_late_documents(spark, docs, rows, monkeypatch, most):
    """Batches in any order of doc_ids: what history holds goes from a later batch, in a batch the smaller doc_id keeps."""
    monkeypatch.setattr(substring_dedup, "MOST_NAMED", most)
    index, lost, order = substring_dedup.FingerprintIndex(spark, scratch(spark)), [], []
    for low, high in ((32, 43), (22, 32), (43, 99), (0, 22)):
        lost.append(index.add(docs.where(f"doc_id >= {low} and doc_id < {high}"), docs))
        order += sorted((d, t) for d, t in rows if low <= d < high)
    out = substring_dedup.without_windows(docs, substring_dedup._union(lost))
    want = [(order[i][0], *r) for i, *r in brute.substring_dedup([(i, t) for i, (_, t) in enumerate(order)])]
    assert found(out, "c0", "n_words", "n_removed", "kept_text") == sorted(want, key=repr)


def test_substring_history_is_not_shuffled(spark, docs):
    """The merge join of a new run with one of history has neither an exchange nor a sort."""
    index = substring_dedup.FingerprintIndex(spark, scratch(spark), 4)
    index.add(docs.where("doc_id < 25"), docs)
    index.add(docs.where("doc_id >= 25"), docs)
    new, old = index.history("grams")[::-1]
    joined = substring_dedup.met(new, old)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_simhash(docs, rows, none):
    got = found(simhash.near_duplicates(twice(docs)), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.simhash(repeated(rows)), key=repr)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("seed, most", [(1, 1 << 20), (8, 10), (10**6, 100)])
def test_links_lose_none(spark, monkeypatch, seed, most):
    """Random walks of one-bit steps: dense buckets, every link within two bits must connect, in forests of any size."""
    monkeypatch.setattr(components, "MOST_NODES", most)
    rng = np.random.default_rng(seed)
    prints = []
    for _ in range(30):
        x = rng.integers(0, 1 << 63, dtype=np.uint64)
        for _ in range(20):
            x ^= np.uint64(1) << np.uint64(rng.integers(64))
            if rng.random() < 0.7:
                x ^= np.uint64(1) << np.uint64(rng.integers(64))
            if rng.random() < 0.2:
                x ^= np.uint64(7) << np.uint64(rng.integers(60))
            prints.append(x)
    prints = np.unique(np.array(prints, np.uint64))
    signed = prints.view(np.int64).tolist()
    want = brute.classes(signed, [(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 2)])
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    assert [roots.get(p, p) for p in signed] == want


@pytest.mark.parametrize("low, most", [(0, 4), (21, 4), (42, 4), (10, 64)])
def test_crowded_keys(spark, low, most):
    """Thousands of fingerprints that differ in twelve neighbouring bits, thinned: buckets are split twice and lose no link."""
    rng = np.random.default_rng(low)
    base = rng.integers(0, 1 << 62, dtype=np.int64)
    prints = np.unique(base ^ (rng.permutation(1 << 12)[:400].astype(np.int64) << low) ^ (rng.integers(0, 2, 400) << 63))
    signed = prints.tolist()
    bits = prints.view(np.uint64)
    want = brute.classes(signed, [(i, j) for i in range(len(signed)) for j in np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= 2)])
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), most)
    roots = {r["node"]: r["root"] for r in components.components(found).collect()}
    assert [roots.get(p, p) for p in signed] == want


def test_finer_keys():
    """Two words at most two bits apart share a finer key; ten chunks leave at most ten bits open."""
    rng = np.random.default_rng(4)
    for i in range(3):
        width, low = simhash.SEGMENTS[i]
        keys = np.full(300, i << 46, np.int64)
        a = rng.integers(-(1 << 63), 1 << 63, 300)
        away = [b for b in range(64) if not low <= b < low + width]
        b = a ^ np.array([int(np.int64(np.uint64(1 << int(x)))) if x < 63 else -(1 << 63) for x in rng.choice(away, 300)]) ^ np.array([1 << int(x) for x in rng.choice([x for x in away if x < 63], 300)])
        for chunks in simhash.CHUNKS:
            one, two = (set(zip(*map(np.ndarray.tolist, simhash.finer(keys, p, chunks)))) for p in (a, b))
            assert {r for r, _ in one & two} == set(range(300))


def test_links_come_from_keys():
    """Fingerprints meet at shared keys alone: with a key for each row nothing links, in whatever batches."""
    import pyarrow as pa

    prints = np.array([1 << i for i in range(60)], np.int64)
    row, key = simhash.golay_keys(prints)

    def met(keys, prints, size):
        order = np.argsort(keys, kind="stable")
        table = pa.table({"key": keys[order], "part": np.zeros(len(keys), np.int64), "print": prints[order]})
        return {(a, b) for t in simhash._met(iter(table.to_batches(max_chunksize=size))) for a, b in zip(*(c.to_pylist() for c in t.columns))}

    links = met(key, prints[row], 1000)
    assert {x for link in links for x in link} == set(prints.tolist()) and links == met(key, prints[row], 7)
    assert met(np.arange(len(row)), prints[row], 1000) == set()


def test_golay():
    code = simhash.Golay()
    rng = np.random.default_rng(1)
    data = rng.integers(0, 1 << 12, 500)
    sent = data << 11 | code.parity[data]
    for n in range(4):
        noise = np.array([sum(1 << int(b) for b in rng.permutation(23)[:n]) for _ in sent])
        assert (code.decode(sent ^ noise) == data).all()
    words = rng.integers(0, 1 << 23, 2000)
    near = words ^ np.array([1 << int(b) for b in rng.integers(0, 23, 2000)]) ^ np.array([1 << int(b) for b in rng.integers(0, 23, 2000)])
    a, b = (set(zip(*map(list, code.nearby(w, 23)))) for w in (words, near))
    assert {r for r, _ in a & b} == set(range(2000))


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(200) if i % 40 != 39] + [(int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2))]
    nodes = sorted({n for e in edges for n in e})
    at = {n: i for i, n in enumerate(nodes)}
    want = dict(zip(nodes, brute.classes(nodes, [(at[a], at[b]) for a, b in edges])))
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert {r["node"]: r["root"] for r in got.collect()} == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe(docs, rows, none):
    lib = library(BYTES)
    want = []
    for d, t in repeated(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), bytes(np.array(ids, "<u4").tobytes()), lib.decode(ids, skip_special_tokens=False)))
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe.decode(bpe.encode(twice(docs), BYTES), BYTES).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    import hashlib

    shas = [(d, n, hashlib.sha256(i).hexdigest(), brute.sha(x)) for d, n, i, x in want]
    assert found(bpe.digests(twice(docs), BYTES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(shas, key=repr)
    assert bpe.digests(none, BYTES).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_encode_like_whole_texts(path):
    import random

    rng, lib, coder = random.Random(3), library(path), tokens.library_coder(path)
    parts = list(" \n\t a'sBé.,\x1c日1!\u00a0") + ["  ", "<|endoftext|>", "'ll", " word", "Éa", "ﬁ", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_coder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 20)
    lib, coder = library(WORDS), tokens.library_coder(WORDS)
    for i in range(30):
        text = f"the same words and w{i} x{i} y{i * 7} z{i}"
        assert coder.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(coder.known) < 60


def test_token_file(spark, docs, rows, none):
    lib, path = library(BYTES), scratch(spark)
    token_file.write_token_files(twice(docs), path, BYTES)
    at, want = 0, []
    for d, t in sorted(repeated(rows), key=lambda r: r[0]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert found(token_file.read_token_files(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    empty = scratch(spark)
    token_file.write_token_files(none, empty, BYTES)
    assert token_file.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("n", [1, 15, 127, 128, 129, 5000, 40_000, 300_001])
def test_rans(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, 50_256)
    tables = token_file.Tables(*token_file.frequencies(np.bincount(ids, minlength=50_257)))
    for lanes in (16, 128, 2048):
        assert (token_file.decode_block(n, *token_file.encode_block(ids, tables, lanes), tables) == ids).all()


def test_packing(docs, rows, none):
    lib = library(WORDS)
    for length in (64, 4096):
        pieces = packing.pack(docs, WORDS, length).cache()
        whole = {}
        for r in sorted(pieces.collect(), key=lambda r: (r["doc_id"], r["start"])):
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert len(ids) == r["length"] and brute.crc(ids) == r["ids_crc32"] and r["start"] == len(whole.setdefault(r["doc_id"], []))
            whole[r["doc_id"]] += ids
        assert whole == {d: lib.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
        fill = {}
        for r in sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == fill.get(r["sequence_id"], 0)
            fill[r["sequence_id"]] = r["offset"] + r["length"]
        assert sorted(fill) == list(range(len(fill))) and all(fill[s] == length for s in fill if s < len(fill) - 1)
        sizes = {len(r["ids"]) // 4 for r in packing.sequences(pieces, length).collect()}
        assert all(s == length or s & (s - 1) == 0 for s in sizes)
    assert packing.pack(none, WORDS).count() == 0


def test_toxicity_edges(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, empty)
    assert out.count() == docs.count() and out.where("score <> 0 or predicted <> 0").count() == 0
    labels = spark.createDataFrame([(d, 1, d % 2) for d in range(60)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels)
    assert out.where("score < 0 or score > 1 or score is null").count() == 0 and out.count() == docs.count()
    assert toxicity.toxicity(none, labels).count() == 0


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    out = toxicity.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    score, label = np.array([r["score"] for r in out]), np.array([r["toxic"] for r in out])
    rank = score.argsort().argsort()
    auc = (rank[label == 1].sum() - label.sum() * (label.sum() - 1) / 2) / (label.sum() * (len(label) - label.sum()))
    assert auc > 0.75 and (score[label == 0] >= 0.7).mean() < 0.05
