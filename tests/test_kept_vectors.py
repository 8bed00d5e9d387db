"""The kept vector index against brute force, through changes, and what a search leaves unread."""

from __future__ import annotations

import numpy as np
import pytest

from sparkatlas.operators import kept_vectors


def frame(spark, vecs):
    return spark.createDataFrame([(int(k), [float(x) for x in v] if v is not None else None) for k, v in vecs.items()], "key long, vec array<float>").repartition(3)


def asked(spark, vecs):
    return frame(spark, vecs).withColumnRenamed("key", "query_id")


def wanted(vecs, queries, k, skip_self=False):
    out = {}
    for q, v in queries.items():
        scores = sorted((-float(np.float32(v).astype(float) @ np.float32(x).astype(float)), i) for i, x in vecs.items() if x is not None and len(x) == len(v) and not (skip_self and i == q))
        out |= {(q, r): (i, round(-s, 6)) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


def answer(found):
    return {(r.query_id, r["rank"]): (r.key, round(r.score, 6)) for r in found.collect()}


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 12))
    clustered = {i: centres[i % 60] + 0.05 * rng.normal(size=12) for i in range(3000)}
    spread = {i: rng.normal(size=12) for i in range(900)}
    return clustered, spread


def test_exact_and_only_near_cells_are_read(spark, world, tmp_path):
    vecs, _ = world
    index = kept_vectors.KeptVectors.at(spark, str(tmp_path), buckets=64).extend(frame(spark, vecs))
    queries = {i: vecs[i] for i in (5, 65)}  # of one cluster
    log: list = []
    assert answer(index.search(asked(spark, queries), 10, log=log)) == wanted(vecs, queries, 10)
    cells = len(index.directory().cell)
    read = index.store.read("vectors", [0]).inputFiles()
    assert sum(n for n, _ in log) < 0.25 * cells * len(queries)
    assert max(b for _, b in log) < 0.5 * len({p.bucket for p in index.store.manifest.parts if p.table == "vectors"}) and len(read) < len(index.store.read("vectors").inputFiles())


@pytest.mark.parametrize("split", [1 << 12, 16])
def test_through_changes(spark, world, tmp_path, monkeypatch, split):
    monkeypatch.setattr(kept_vectors, "SPLIT", split)
    _, vecs = world
    vecs = dict(vecs) | {5000: None, 5001: [], 5002: [1.0, 2.0]}
    index = kept_vectors.KeptVectors.at(spark, str(tmp_path), buckets=8).extend(frame(spark, vecs))
    queries = {i: vecs[i] for i in range(0, 900, 90)}
    assert answer(index.search(asked(spark, queries), 7, skip_self=True)) == wanted(vecs, queries, 7, True)
    rng = np.random.default_rng(1)
    new = {i: 2 * rng.normal(size=12) for i in [*range(40, 90), *range(2000, 2040)]}
    gone = list(range(300, 400))
    index = index.extend(frame(spark, new), spark.createDataFrame([(i,) for i in gone], "key long"))
    vecs = {i: v for i, v in (vecs | new).items() if i not in gone}
    assert answer(kept_vectors.KeptVectors.at(spark, str(tmp_path), buckets=8).search(asked(spark, queries), 7)) == wanted(vecs, queries, 7)
    compact = kept_vectors.KeptVectors(index.store.compact(0))
    assert answer(compact.search(asked(spark, queries), 7)) == wanted(vecs, queries, 7)


def test_copies_few_and_none(spark, tmp_path):
    same = {i: [1.0, 0.0] for i in range(200)} | {300: [0.0, 1.0]}
    index = kept_vectors.KeptVectors.at(spark, str(tmp_path / "a"), buckets=2).extend(frame(spark, same))
    queries = {7: [1.0, 0.0], 8: [0.0, 0.0]}
    assert answer(index.search(asked(spark, queries), 5)) == wanted(same, queries, 5)
    assert answer(index.search(asked(spark, queries), 500)) == wanted(same, queries, 500)
    empty = kept_vectors.KeptVectors.at(spark, str(tmp_path / "b"), buckets=2).extend(frame(spark, {1: None}))
    assert answer(empty.search(asked(spark, queries), 5)) == {}
