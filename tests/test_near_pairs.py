"""The hyperplane index: planted pairs found, recall and comparisons measured."""

from __future__ import annotations

import numpy as np
import pytest

from sparkatlas.operators import near_pairs as N


def world(n, planted, cosine, seed, width=32):
    """Independent vectors, and partners at this cosine of the first few."""
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, width))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    side = rng.standard_normal((planted, width))
    side -= (side * m[:planted]).sum(axis=1, keepdims=True) * m[:planted]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.vstack((m, cosine * m[:planted] + np.sqrt(1 - cosine**2) * side))


def frame(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "key long, vec array<double>").repartition(3)


def brute(m, t):
    s = m @ m.T
    return {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= t, 1)))}


def test_recall_and_comparisons_on_planted_pairs(spark):
    per_vector = []
    for n in (1500, 6000):
        m = world(n, 300, 0.86, n)
        log: dict = {}
        rows = N.near_pairs(frame(spark, m), 0.85, 0.95, log=log).collect()
        got, want = {(r.a, r.b) for r in rows}, brute(m, 0.85)
        assert len(got) == len(rows) and got <= want and len(want) >= 300
        assert len(got) >= 0.9 * len(want)
        assert log["candidates"] < 10 * len(want) < 1e-3 * len(m) ** 2
        per_vector.append(log["compared"] / len(m))
    assert per_vector[1] < 0.2 * 6300 / 2  # of the partners that each would meet without an index
    assert per_vector[1] < 2.5 * per_vector[0]  # four times the vectors


@pytest.mark.parametrize("chunk", [1 << 11, 8])
def test_copies_and_large_buckets(spark, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    near = [base + 0.02 * rng.standard_normal(16) for _ in range(60)]
    m = np.array(near + [base] * 20 + list(rng.standard_normal((100, 16))) + [-base])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = N.near_pairs(frame(spark, m * 3), 0.9, 0.999, bands=N.Bands(6, 12)).collect()
    got = {(r.a, r.b): r.similarity for r in rows}
    assert len(got) == len(rows) and set(got) == brute(unit, 0.9)
    assert all(abs(s - unit[a] @ unit[b]) < 1e-9 for (a, b), s in got.items())


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [2.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [3.0, 0.01, 0.0])]
    got = N.near_pairs(spark.createDataFrame(rows, "key long, vec array<double>")).collect()
    assert {(r.a, r.b) for r in got} == {(4, 5), (6, 7)}
    assert N.near_pairs(spark.createDataFrame([], "key long, vec array<double>")).count() == 0


def test_plans_keep_their_word():
    for n in (10, 10_000, 10**9):
        for t, r in ((0.85, 0.95), (0.38, 0.9), (0.99, 0.999)):
            b = N.plan(n, t, r)
            assert 1 - (1 - N.same_side(t) ** b.bits) ** b.bands >= r


def test_vectors_are_signed_some_at_a_time(spark, monkeypatch):
    seen = N.signatures(np.eye(40), N.Bands(4, 30), 7)[1]
    assert seen.shape == (40, 30) and N.SIGNED * 64 * 64 * 8 <= 1 << 24
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.repeat(np.random.default_rng(2).standard_normal((40, 8)), 2, axis=0) + np.tile([0, 1e-3], 40)[:, None])]
    found = []
    for n in (7, 512):
        monkeypatch.setattr(N, "SIGNED", n)
        found.append(sorted((r.a, r.b) for r in N.near_pairs(spark.createDataFrame(rows, "key long, vec array<double>"), 0.95, 0.999).collect()))
    assert found[0] == found[1] and len(found[0]) >= 40
