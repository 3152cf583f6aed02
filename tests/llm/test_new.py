"""Mixing, periodic runs and conversation repair against plain programs."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbase.llm import conversations, mixing, periodic


# Mixing


def targets(sizes, share=Fraction(3, 2), most=2, weights=(3, 1, 2)):
    """Round by round: what is over a source's limit is shared by weight among the others."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = Fraction(left, sum(weight[s] for s in open_))
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = Fraction(most * sizes[s])
        open_ -= full
        left -= sum(out[s] for s in full)
    return out


def mix_rows(rng, sources, n):
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " \n", "x y", "a b c\x0bd", "w " * rng.randint(1, 60)])
        rows.append((rng.choice([None, i, i, i, 7]), rng.choice(sources), text))
    return rows + rows[: n // 5]


@pytest.mark.parametrize("sources", [["b", None, "a", "\U0001f600", "￿", "Z"], ["only"], [None], ["big"] * 20 + [f"s{i}" for i in range(9)]])
def test_mixing(spark, sources):
    rows = mix_rows(random.Random(len(sources)), sources, 300)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", mixing.n_words(F.col("text"))).withColumn("rate", F.lit("clash")).withColumn("of", F.lit("clash"))
    out = mixing.mixture(df).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    goal = targets(sizes)
    assert sorted(((r["doc_id"], r["source"], r["text"]) for r in out), key=repr) == sorted(rows, key=repr)
    for r in out:
        assert r["size"] == len(brute.words(r["text"])) and r["source_size"] == sizes[r["source"]] and r["rate"] == "clash"
        assert r["target"] == pytest.approx(float(goal[r["source"]]), abs=1e-9)
        rate = goal[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        u = int(hashlib.md5(f"42:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13
        copies = rate.__floor__() + (u < rate - rate.__floor__()) if rate else 0
        assert r["taken"] == copies * r["size"] <= 2 * r["size"] and r["copies"] == copies


def test_mixed_documents(spark, docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(sized).collect()}
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {d: c for d, c in copies.items() if c}
    assert mixing.mixed(docs.where("false")).count() == 0


def test_mixing_query(spark):
    out = mixing.op11_source_mix(spark, "/root/testdata/sf0.1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = out.withColumn("source", F.col("source_size")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()
    for r in rows:  # the deviation of a sum of draws
        assert r["size"] == r["source_size"] and abs(r["taken"] - r["target"]) < 0.15 * r["target"]
    assert abs(sum(r["taken"] for r in rows) / sum(1.5 * r["size"] for r in rows) - 1) < 0.03
    assert sorted(out.collect()) == sorted(mixing.op11_source_mix(spark, "/root/testdata/sf0.1").repartition(7).collect())


def test_mixing_many_tables_have_no_words(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [(r["target"], r["taken"]) for r in mixing.mixture(df).collect()] == [(0.0, 0)] * 2


# Periodic runs


def runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sequences():
    rng = random.Random(3)
    for _ in range(400):
        n, k = rng.randint(0, 200), rng.choice([1, 2, 3, 60])
        w = [f"w{rng.randrange(k)}" for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 10 else 0):
            a, p = rng.randrange(n), rng.randint(1, 15)
            for i in range(a, min(n, a + rng.randint(20, 90))):
                w[i] = w[a + (i - a) % p]
        yield w


def test_z_functions():
    rng = random.Random(2)
    for _ in range(200):
        s, t = ([rng.randrange(2) for _ in range(rng.randint(0, 30))] for _ in range(2))
        common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        z = periodic.z_function(s)
        assert z == [common(s, s[i:]) for i in range(len(s))]
        assert periodic.matches(t, len(t), s, z) == [common(s, t[i:]) for i in range(len(t))]


def test_main_lorentz():
    met = 0
    for w in sequences():
        ids = np.array([hash(x) % 1000 for x in w] if len(set(w)) < 60 else [int(x[1:]) for x in w], np.int64)
        want = runs(ids.tolist())
        met += len(want)
        assert periodic.main_lorentz(ids) == want
        (own,) = periodic.regions(ids, np.array([len(ids)]))
        assert (periodic.main_lorentz(ids, own) if own else []) == want
    assert met > 100


def expected_runs(doc_id, text, plant=True):
    w = brute.words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = runs(w)
    gone = {i for s, length, q in r for i in range(s + q, s + length)}
    best = min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in r)
    return doc_id, len(r), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, brute.sha(lines), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_query(spark, tmp_path):
    rows = [(i, " ".join(w)) for i, w in enumerate(sequences())] + [(None, "a " * 40), (1000, None), (1001, ""), (1002, " \n"), (-7, "a b " * 30), (1003, "x y " * 25 + "\x0b\x1c")]
    rows += rows[:40]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = periodic.op12_periodic_runs(spark, str(tmp_path)).select(NAMES)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((expected_runs(*r) for r in rows), key=repr)


def test_periodic_on_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = [(d, t) for d, t in docs if len(brute.words(t)) < 3000]
    got = {r["doc_id"]: tuple(r) for r in periodic.op12_periodic_runs(spark, "/root/testdata/sf0.001").select(NAMES).collect()}
    want = {d: expected_runs(d, t) for d, t in docs}
    assert {d: got[d] for d in want} == want and sum(r[1] > 0 for r in want.values()) > 5


def test_periodic_columns(spark, docs):
    clashing = docs.withColumn("runs", F.lit("clash")).withColumn("collapsed_text", F.lit("clash"))
    out = periodic.periodic_runs(clashing)
    assert set(docs.columns) - {"n_words"} <= set(out.columns) and out.where("kept <> 'clash'").count() == 0
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]]) for r in out.collect()}
    assert got == {r["doc_id"]: (len(w := brute.words(r["text"])), runs(w) if len(w) < 2000 else got[r["doc_id"]][1]) for r in docs.collect()}
    assert periodic.periodic_runs(clashing.where("false")).count() == 0


# Conversations


def repair(rows):
    """rows: (turn, role, text) in order, after damage; what a plain program reports."""
    counts, seen, items = dict(blank=0, duplicate=0, truncated=0), set(), []
    for _, role, text in rows:
        last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        items.append((role[:1], fault))
    # from the end: least (cost, audit) from each row on, by what stands before: "" nothing, s, u, a
    after = lambda have, give: give in {"": "su", "s": "u", "u": "a", "a": "u"}[have]
    best = {}
    for i in range(len(items), -1, -1):
        here = {h: (0, "") for h in ("", "a")} if i == len(items) else {}
        if i < len(items):
            initial, fault = items[i]
            for h in ("", "s", "u", "a"):
                ways = [(3, "D", h)]
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    ways += [(2 + more, "R", g) for g in "ua" if after(h, g)] + ([(more, "K", initial)] if initial and initial in "sua" and after(h, initial) else [])
                here[h] = min((c + best[i + 1, g][0], e + best[i + 1, g][1]) for c, e, g in ways if (i + 1, g) in best)
        for _ in range(5):  # insertions
            for h in ("", "s", "u", "a"):
                for g in "ua":
                    if after(h, g) and g in here:
                        here[h] = min(here.get(h, (1 << 60, "")), (2 + here[g][0], "I" + here[g][1]))
        best |= {(i, h): v for h, v in here.items()}
    cost, audit = best[0, ""]
    lines, have, at = [], "", 0
    for e in audit:
        role = rows[at][1] if e != "I" else None
        if e != "D":
            have = role[:1] if e == "K" else next(g for g in "ua" if after(have, g))
            lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[have]}:{rows[at][2] if e != 'I' else ''}")
        at += e != "I"
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, brute.sha("\n".join(lines)))


def damage(rows):
    out = {}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind, text, role = zlib.crc32(key.encode()) % 20, " " if text is None else text, " " if role is None else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    head = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2][:64].encode(), hashlib.md5(x[2].encode()).hexdigest())
    return {c: sorted(v, key=head) for c, v in out.items()}


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def talk_rows():
    rng = random.Random(6)
    said = ["Yes.", "No", "", " \t", "Why?", "a. ", "long " * 40 + "x.", "long " * 40 + "y.", "... \n", None]
    rows = []
    for c in [None, *range(150)]:
        n = rng.choice([1, 2, 3, 5, 8, 8, 12])
        for t in range(n):
            role = rng.choice(["user" if t % 2 else "assistant", "user", "system", "tool", "", None]) if rng.random() < 0.4 else ["user", "assistant"][t % 2] if c and c % 3 else ["system", "user", "assistant"][t % 3 if t < 3 else 1 + (t - 1) % 2]
            rows.append((c, rng.choice([t, t, t, t + 1, 100, None]) if rng.random() < 0.3 else t, role, rng.choice(said) if rng.random() < 0.5 else f"word {c} {t}."))
    rows += [(500, t, ["user", "assistant"][t % 2], rng.choice(["One.", "Two", f"{t}!"])) for t in range(700)]
    rows += [(501, 0, "user", "The same.")] * 300 + [(501, 1, "assistant", "Fine.")]
    drop = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + rows[:30] + [(drop, 0, "user", "Gone.")], drop


@pytest.mark.parametrize("segment, partitions", [(1024, 4), (5, 7), (100, 1)])
def test_conversations(spark, monkeypatch, tmp_path, segment, partitions):
    rows, drop = talk_rows()
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    want = sorted(((c, *repair(v)) for c, v in damage(rows).items()), key=repr)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("copies", F.lit("clash"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
        got = sorted((tuple(r) for r in conversations.op13_conversation_repair(spark, str(tmp_path)).select(REPORT).collect()), key=repr)
        table = conversations.segments(conversations.damaged(df))
        lines = {}
        for r in sorted(conversations.turns(table).collect(), key=lambda r: (r["part"], r["seq"], r["turn"])):
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == want
    assert (drop, 0, 0, 0, 0, 0, 0, "", brute.sha("")) in got
    assert {c: brute.sha("\n".join(x)) for c, x in lines.items()} == {r[0]: r[-1] for r in got if r[0] in lines} and sum(bool(r[-2].strip("D")) for r in got) == len(lines)


def test_audits_are_least():
    """The chart against all edits of short conversations."""
    good = re.compile("(s?(ua)+)?")
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3, 0) for _ in range(rng.randint(0, 4))]
        found = []
        for size in range(2 * len(rows) + 4):
            for audit in itertools.product("DIKR", repeat=size):
                if sum(e != "I" for e in audit) != len(rows) or audit.count("I") > 4:
                    continue
                at, said, cost = 0, [""], 0
                for e in audit:
                    if e == "I":
                        said, cost = [x + g for x in said for g in "ua"], cost + 2
                        continue
                    initial, must_go, cut, _ = rows[at]
                    at += 1
                    if e != "D" and must_go:
                        said = []
                    cost += {"D": 3, "K": cut, "R": 2 + cut}[e]
                    said = said if e == "D" else [x + g for x in said for g in (initial if e == "K" else "ua")]
                if any(good.fullmatch(x) for x in said):
                    found.append((cost, "".join(audit)))
            if len(rows) == 4 and size > 6:
                break
        assert conversations.best_end(conversations.parse(rows))[:2] == min(found)


def test_conversations_on_tables(spark):
    folder = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in conversations.op13_conversation_repair(spark, folder).select(REPORT).collect())
    assert got == sorted((c, *repair(v)) for c, v in damage(rows).items())
    assert conversations.reports(conversations.segments(conversations.damaged(spark.read.parquet(f"{folder}/conversations.parquet").where("false")))).count() == 0
