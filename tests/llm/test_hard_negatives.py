"""Hard negatives against brute force, and what the index skips."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkatlas.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score double, block string"


def clustered(n, seed=1, width=6, centres=12, spread=0.02):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return [(i, (c[i % centres] + rng.normal(size=width) * spread).astype(np.float32).tolist(), int(rng.integers(0, 4)), 0.0, "x") for i in range(n)]


def brute(rows, every, positives=5, negatives=10, low=30, high=90):
    own = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and sum((abs(256 * x) + 1) ** 2 for x in v) < 2**56]
    out = []
    for a, la, va in own:
        if a % every:
            continue
        s = [(-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in own if i != a]
        for ps, p, _ in sorted(x for x in s if x[2] == la)[:positives]:
            fit = sorted(x for x in s if x[2] != la and low * -ps <= 100 * -x[0] <= high * -ps)[:negatives]
            out += [(a, p, rank, n, -ps, -ns) for rank, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


def answer(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def mined(spark, rows, every, **kw):
    return hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % every == 0, **kw)


def test_independent_and_clustered(spark):
    rng = random.Random(2)
    rows = clustered(700) + [(1000 + i, [rng.gauss(0, 1) for _ in range(6)], rng.randrange(4), 0.0, "y") for i in range(300)]
    expected = brute(rows, 10)
    assert len(expected) > 1000
    assert answer(mined(spark, rows, 10, block=16)) == expected
    assert answer(mined(spark, rows, 10, block=16, positives=2, negatives=3, low=50, high=100)) == brute(rows, 10, 2, 3, 50, 100)


def test_awkward_rows(spark):
    base = [3.0, 4.0, 0.5]
    rows = [(i, base, i % 2, 0.0, "") for i in range(60)]  # copies: all ties
    rows += [(100, None, 1, 0.0, ""), (110, [1.0, None, 2.0], 1, 0.0, ""), (120, [float("nan")] * 3, 1, 0.0, ""), (130, [float("inf"), 0.0, 0.0], 0, 0.0, ""), (None, base, 1, 0.0, ""), (140, base, None, 0.0, "")]
    rows += [(150, [], 1, 0.0, ""), (160, [2.0], 0, 0.0, ""), (170, [2.0, 3.0, 1.0, 9.0], 1, 0.0, ""), (180, [1e30, 0.0, 0.0], 1, 0.0, ""), (190, [0.0, 0.0, 0.0], 1, 0.0, ""), (200, [-3.0, -4.0, 0.0], 0, 0.0, "")]
    rows += [(40, base, 0, 0.0, ""), (41, [3.0, 3.0, 3.0], 1, 0.0, ""), (40, [1.0, 2.0, 3.0], 1, 0.0, "")]  # repeated ids
    rows += [(300 + i, [2.0, 2.0 + i / 50, 0.1], i % 3, 0.0, "") for i in range(40)]
    assert answer(mined(spark, rows, 10, block=8)) == brute(rows, 10)


def test_long_vectors_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-300_000, 300_000)) for _ in range(4)], i % 3, 0.0, "") for i in range(200)]
    assert max(sum((256 * x) ** 2 for x in v) for _, v, *_ in rows) > 2**53
    assert answer(mined(spark, rows, 5, block=16)) == brute(rows, 5)


def test_empty(spark):
    assert answer(mined(spark, [], 10)) == []
    assert answer(mined(spark, [(100, None, 1, 0.0, "")], 10)) == []
    assert answer(mined(spark, [(10, [1.0], 1, 0.0, "")], 10)) == []
    assert answer(mined(spark, clustered(50), 1000)) == brute(clustered(50), 1000)


def test_clusters_are_skipped(spark):
    """Anchors' bands end near their own cluster; most blocks are never scanned."""
    rows = clustered(4000, centres=40, width=8, spread=0.01)
    index = hn.build(hn.prepared(spark.createDataFrame(rows, SCHEMA)), block=32)
    probes = index.rows.where("vec_id % 100 = 0").select(F.monotonically_increasing_id().alias("probe"), "vec_id", "label", "v").withColumn("lo", F.array(F.lit(hn.LEAST))).withColumn("hi", F.array(F.lit(hn.MOST)))
    log = []
    assert hn.search(index, probes, 5, True, log).count() == 5 * 40
    assert sum(log) < 0.2 * 40 * len(index.keys.block)


def test_bounds_hold(spark):
    rows = clustered(500, spread=0.3)
    index = hn.build(hn.prepared(spark.createDataFrame(rows, SCHEMA)), block=8)
    got = index.rows.toPandas()
    v = np.frombuffer(b"".join(got.v), "<i4").reshape(len(got), -1).astype(float)
    near, far = hn._bounds(index.keys, v[:20])
    d = hn._distances(np.column_stack((v[:20], np.zeros(20))), hn._lifted(v, index.keys.longest))
    at = np.searchsorted(index.keys.block, got.block)
    assert (d >= near[:, at] - 1e-6).all() and (d <= far[:, at] + 1e-6).all()
    assert got.groupby("block").size().max() <= 8
