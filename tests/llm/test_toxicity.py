"""The network's scores against a plain loop over all windows, its gradients against differences, held-out accuracy."""

import random

import numpy as np

from lumenbase.llm import toxicity as X


def network(seed=3):
    net = X.Network(seed)
    rng = np.random.default_rng(seed)
    for k, v in net.p.items():  # weights large enough for scores to differ
        net.p[k] = (rng.standard_normal(v.shape) * 0.4).astype(np.float32)
    return net


def plain_logit(p, words):
    """One window, word by word."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    xs = []
    for w in words:
        own, chars, _ = X._slots([w])
        xs.append(p["word"][own[0]] + p["char"][chars].sum(0) / np.sqrt(len(chars)))

    def read(d, order):
        h, out, n = np.zeros(X.HIDDEN), {}, X.HIDDEN
        for t in order:
            g, a = xs[t] @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
            r, z = sigmoid(g[:n] + a[:n]), sigmoid(g[n : 2 * n] + a[n : 2 * n])
            h = (1 - z) * np.tanh(g[2 * n :] + r * a[2 * n :]) + z * h
            out[t] = h
        return out

    f, b = read("f", range(len(words))), read("b", range(len(words) - 1, -1, -1))
    states = [np.concatenate([f[t], b[t]]) for t in range(len(words))]
    weight = np.exp([np.tanh(s @ p["A"]) @ p["v"] for s in states])
    return (weight[:, None] * states).sum(0) / weight.sum() @ p["o"] + p["bias"][0]


def plain_score(p, text):
    words = [w.strip(".,;:!?\"'()[]") for w in (text or "").lower().split()]
    starts = [0]
    while starts[-1] + X.WINDOW < len(words):
        starts.append(min(starts[-1] + X.STRIDE, len(words) - X.WINDOW))
    logits = sorted((plain_logit(p, words[s : s + X.WINDOW]) for s in starts), reverse=True) if words else [p["bias"][0]]
    return 1 / (1 + np.exp(-np.mean(logits[: X.TOP])))


def test_scores_equal_a_plain_loop(monkeypatch):
    """All windows of texts of any length, in any company, also when words are forgotten in between."""
    rng = random.Random(2)
    made = ["".join(rng.choice("abcdeäé!,") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    texts = [None, "", " \n", "one", "...", *(" ".join(rng.choice(made) for _ in range(n)) for n in (2, 31, 32, 33, 47, 48, 49, 64, 100, 333))]
    net = network()
    want = [plain_score(net.p, t) for t in texts]
    assert np.allclose(X.Scorer(net)(texts), want, atol=1e-4) and np.ptp(want) > 0.05
    scorer = X.Scorer(net)
    monkeypatch.setattr(X, "MOST_WORDS", 10)
    assert np.allclose([scorer([t])[0] for t in texts], want, atol=1e-4)


def test_windows_cover_every_word():
    for n in range(1, 400):
        starts = X.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + X.WINDOW))} == set(range(n)) and all(b - a <= X.STRIDE for a, b in zip(starts, starts[1:]))


def test_gradients():
    """Each weight's and input's gradient against the difference that a small step makes, in double precision."""
    net, rng = network(5), np.random.default_rng(6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in ("word", "char")}
    x = rng.standard_normal((5, 9, 6 * X.HIDDEN))
    mask = np.arange(9) < np.array([9, 4, 1, 9, 7])[:, None]
    weight = rng.standard_normal(5)
    loss = lambda: float(weight @ net.forward(x, mask))
    trace = {}
    net.forward(x, mask, trace)
    dx, g = net.backward(weight, mask, trace)

    def differs(array, at, step=2e-2):
        old = array[at]
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        return (up - down) / (2 * step)

    for k, grad in g.items():
        for at in list(np.ndindex(grad.shape))[:: max(1, grad.size // 40)]:
            assert abs(differs(net.p[k], at) - grad[at]) < 2e-3 + 0.02 * abs(grad[at]), (k, at)
    for at in list(np.ndindex(x.shape))[::37]:
        want = differs(x, at)
        assert abs(want - dx[at]) < 2e-3 + 0.02 * abs(want) and (mask[at[:2]] or dx[at] == 0)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    out = X.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    score, label = np.array([r["score"] for r in out]), np.array([r["toxic"] for r in out])
    rank = score.argsort().argsort()
    auc = (rank[label == 1].sum() - label.sum() * (label.sum() - 1) / 2) / (label.sum() * (len(label) - label.sum()))
    assert auc >= 0.93 and (score[label == 1] >= X.THRESHOLD).mean() >= 0.85 and (score[label == 0] >= X.THRESHOLD).mean() <= 0.04


def test_repeated_rows_and_long_texts(spark):
    """Repeated rows, null ids and a text of thousands of windows among labelled ones."""
    rng = random.Random(4)
    good, bad = ([f"{k}{i}" for i in range(40)] for k in ("calm", "vile"))
    rows = [(i, " ".join(rng.choice(bad if i % 2 and rng.random() < 0.7 else good) for _ in range(40))) for i in range(160)]
    rows += [(500, " ".join(rng.choice(good) for _ in range(30_000))), (None, "calm1 calm2"), (None, "calm1 calm2"), rows[3], rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(160)] + [(3, 1, 1), (500, 1, 0)], "doc_id long, quality int, toxic int")
    out = X.toxicity(df, labels).collect()
    assert len(out) == len(rows) and all(np.ptp([r["score"] for r in out if r["doc_id"] == d]) < 1e-5 for d in (3, 4, None))
    scores = {r["doc_id"]: r["score"] for r in out}
    assert np.mean([scores[i] for i in range(1, 160, 2)]) > np.mean([scores[i] for i in range(0, 160, 2)]) + 0.3 and scores[500] < 0.7
