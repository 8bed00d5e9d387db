"""Language model and quality classifier."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkatlas.llm import crf_quality, gated_lm


def small_vocabulary(n=400, soft=250, classes=12):
    """A head of which some words have a softmax; the counts of others are known, and 100 more words are not."""
    rng = np.random.default_rng(2)
    counts = np.sort(np.floor(3 + 20000 / np.arange(1, n + 1) + rng.random(n) * 5))[::-1]
    return gated_lm.Vocabulary(np.arange(1000, 1000 + n, dtype=np.uint64), counts, int(counts.sum()) + 200, n + 100, soft, classes)


def loud(vocab, seed, scale=0.4, kind=np.float64):
    """Random weights, large enough to matter."""
    rng = np.random.default_rng(seed)
    p = gated_lm.Params.fresh(vocab)
    for f in gated_lm.fields(p):
        a = getattr(p, f.name)
        setattr(p, f.name, (a + rng.standard_normal(a.shape) * scale).astype(kind))
    return p


def test_lm_gradients():
    vocab = small_vocabulary()
    rng = np.random.default_rng(6)
    p = loud(vocab, 1)
    net = gated_lm.Network(vocab, p)
    words = rng.integers(0, 401, (5, 3))
    inputs, target = vocab.input[words], rng.integers(0, 401, 15)
    fresh, h0 = np.zeros((5, 3), bool), rng.standard_normal((3, gated_lm.WIDTH)) * 0.5
    fresh[2, 1] = True

    def total():
        states, trail = net.states(inputs, fresh, h0)
        logp, g = net.outputs(states.reshape(-1, gated_lm.WIDTH), target, learn=True)
        return logp.sum(), g, trail

    _, g, trail = total()
    back = net.backward(inputs, fresh, trail, g["h"].reshape(5, 3, -1))
    y, e = np.zeros_like(p.y), np.zeros_like(p.e)
    for own, d in g["y"]:
        y[own] += d
    e[back["rows"]] = back["e"]
    for name, grad in {"w": g["w"], "y": y, "e": e, "q": back["q"], "u": back["u"]}.items():
        a = getattr(p, name)
        for i in np.argsort(-np.abs(grad), axis=None)[:40:5]:
            at = np.unravel_index(i, a.shape)
            kept, eps = a[at], 1e-5
            a[at] = kept + eps
            up = total()[0]
            a[at] = kept - eps
            down = total()[0]
            a[at] = kept
            assert (up - down) / (2 * eps) == pytest.approx(float(grad[at]), rel=1e-3, abs=1e-5), name


@pytest.mark.parametrize("scale", [0.4, 30.0])
def test_lm_is_a_distribution(scale):
    vocab = small_vocabulary()
    n = len(vocab.count)
    net = gated_lm.Network(vocab, loud(vocab, 3, scale))
    assert (net.safe_w and net.safe_y) == (scale < 1)
    h = np.tanh(np.random.default_rng(4).standard_normal((2, gated_lm.WIDTH)))
    p = [np.exp(net.outputs(np.repeat(h[k : k + 1], n + 1, axis=0), np.arange(n + 1), learn=False)[0]) for k in (0, 1)]
    # the last number stands for all other words, whose joined counts come on top: here their sum
    others = vocab.tail_mass - (vocab.count[vocab.soft :] + 0.5).sum()
    for own in p:
        assert own[:n].sum() + own[n] * others / vocab.tail_mass == pytest.approx(1.0, abs=1e-6)
    if scale < 1:  # every word of a softmax depends on the state, given its class as well
        kind = vocab.kind[: vocab.soft]
        given = [own[: vocab.soft] / np.bincount(kind, own[: vocab.soft])[kind] for own in p]
        assert (np.abs(given[0] - given[1]) > 1e-9)[np.bincount(kind)[kind] > 1].all()


def test_softmaxes_go_by_blocks_of_rows(monkeypatch):
    """No block holds the scores of all rows, and blocks change neither probabilities nor gradients."""
    vocab = small_vocabulary()
    net = gated_lm.Network(vocab, loud(vocab, 9))
    rng = np.random.default_rng(10)
    h, words = np.tanh(rng.standard_normal((3000, gated_lm.WIDTH))), rng.integers(0, 401, 3000)
    sizes, softmax = [], gated_lm._softmax
    monkeypatch.setattr(gated_lm, "_softmax", lambda x, safe: sizes.append(x.size) or softmax(x, safe))
    monkeypatch.setattr(gated_lm, "CACHED_ROWS", 1 << 20, raising=False)
    whole, one = net.outputs(h, words, learn=True)
    assert max(sizes) == 3000 * (vocab.classes + 1)
    sizes.clear()
    monkeypatch.setattr(gated_lm, "CACHED_ROWS", 7, raising=False)
    parts, two = net.outputs(h, words, learn=True)
    assert max(sizes) <= 7 * (vocab.classes + 1)
    assert parts == pytest.approx(whole, rel=1e-12) and two["h"] == pytest.approx(one["h"], abs=1e-9) and two["w"] == pytest.approx(one["w"], abs=1e-9)
    for (own, x), (same, y) in zip(one["y"], two["y"], strict=True):
        assert own == same and x == pytest.approx(y, abs=1e-9)


def plain_score(p, vocab, ids):
    """ln probability of one document, word by word with the textbook equations."""
    n, sigmoid = gated_lm.WIDTH, lambda x: 1 / (1 + np.exp(-x))
    h, previous, out = np.zeros(n), vocab.soft + 1, 0.0
    for word in ids:
        x = p.e[previous] @ p.q[:-1] + p.q[-1]
        z, r = (sigmoid(x[k * n : (k + 1) * n] + h @ p.u[:, k * n : (k + 1) * n]) for k in (0, 1))
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * (h @ p.u[:, 2 * n :]))
        softmax = lambda a: np.exp(a) / np.exp(a).sum()
        kind = vocab.kind[word]
        out += math.log(softmax(p.w[:, :n] @ h + p.w[:, n])[kind])
        if word < vocab.soft:
            own = np.flatnonzero(vocab.kind[: vocab.soft] == kind)
            out += math.log(softmax(p.y[own, :n] @ h + p.y[own, n])[list(own).index(word)])
        elif word < len(vocab.count):
            out += math.log((vocab.count[word] + 0.5) / vocab.tail_mass)
        previous = vocab.input[word]
    return out


def test_scores_match_a_plain_recurrence(monkeypatch):
    """Many documents side by side, in short windows, over few streams, score as each does alone."""
    monkeypatch.setattr(gated_lm, "STREAMS", (3, 4))
    monkeypatch.setattr(gated_lm, "STEP_TOKENS", 40)
    vocab = small_vocabulary()
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 401, n).astype(np.int32) for n in (1, 150, 7, 33, 2, 90, 1, 64)]
    p = loud(vocab, 5, kind=np.float32)
    got = gated_lm.score_batch(gated_lm.Network(vocab, p), np.concatenate(docs), np.array([len(d) for d in docs]))
    wide = gated_lm.Params(*(getattr(p, f.name).astype(np.float64) for f in gated_lm.fields(p)))
    assert got == pytest.approx([plain_score(wide, vocab, d) for d in docs], rel=1e-4)


def test_training_carries_the_state_through_a_document(monkeypatch):
    vocab = small_vocabulary()
    clean = []
    states = gated_lm.Network.states
    monkeypatch.setattr(gated_lm.Network, "states", lambda self, i, fresh, h, learn=True: clean.append(int(fresh.sum())) or states(self, i, fresh, h, learn))
    gated_lm.Trainer(gated_lm.Network(vocab, gated_lm.Params.fresh(vocab))).batch(np.arange(1601, dtype=np.int32) % 400, np.array([1601]))
    assert sum(clean) == 1 and len(clean) > 20


@pytest.mark.parametrize("head, soft", [(1 << 17, 1 << 15), (40, 7)])
def test_lm_scores(docs, rows, head, soft, spark):
    got = {r.doc_id: r for r in gated_lm.score(docs, head=head, rounds=2, soft=soft, classes=5).collect()}
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(gated_lm._LOWER)), None]
    learn = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in learn for w in split(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        words = split(t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert r.score < 0


def test_lm_learns_alike_however_the_table_is_partitioned(spark, no_docs):
    rng = random.Random(0)
    langs = [[f"{c}{i}" for i in range(30)] for c in "ab"]
    rows = [(i, " ".join(rng.choices(langs[i % 2], k=80))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{r.doc_id: r for r in gated_lm.score(table.repartition(n)).withColumn("held_out", gated_lm.held_out()).collect()} for n in (1, 5)]
    held = [r for r in found[0].values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert [found[1][i].score for i, _ in rows] == pytest.approx([found[0][i].score for i, _ in rows], rel=1e-4)
    assert gated_lm.score(no_docs).count() == 0


def quality_rows(n=240):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        lines = [" ".join(rng.choices(["quiet", "river", "under", "stones", "of", "the"], k=rng.randint(4, 12))) + "." for _ in range(rng.randint(1, 8))]
        if not good:
            lines[rng.randrange(len(lines)) :] = ["BUY### NOW!!! $$$ %%% " * rng.randint(1, 4) for _ in range(4)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_crf_quality(spark, docs, no_docs):
    rows, labels = quality_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, None, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    model = crf_quality.train(frame, marks)
    out = {r.doc_id: r.score for r in crf_quality.score(frame, model).collect()}
    held = [(out[i] >= 0.7) == bool(q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(held) >= 0.95 * len(held) and all(0 <= s <= 1 for s in out.values())
    awkward = crf_quality.score(docs, model).collect()
    assert len(awkward) == docs.count() and all(0 <= r.score <= 1 for r in awkward)
    assert crf_quality.score(no_docs, crf_quality.train(no_docs, marks.limit(0))).count() == 0


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    bounds = np.array([0, 3, 3, 7, 8])
    emit, trans = rng.standard_normal(8), rng.standard_normal((2, 2))
    good, pairs = crf_quality.Chains(bounds).marginals(emit, trans)
    want_good, want_pairs = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = b - a
        if not n:
            continue
        z = 0.0
        sums, moves = np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = math.exp(sum(emit[a + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            sums += w * np.array(y)
            for k in range(n - 1):
                moves[y[k], y[k + 1]] += w
        want_good[a:b] = sums / z
        want_pairs += moves / z / n
    assert good == pytest.approx(want_good) and pairs == pytest.approx(want_pairs)


def test_training_takes_one_row_an_id_and_bounded_lines(spark):
    rows, labels = quality_rows(60)
    rows += [(rows[0][0], "line\nof a copy\n" * 5)] * 40 + [(rows[1][0], "y\n" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own, size, bounds, y, _ = crf_quality.training_features(docs, spark.createDataFrame(labels, "doc_id long, quality long, toxic long"), 1500, max_lines=5000)
    assert len(own) == bounds[-1] <= 5000 and len(y) <= 60
