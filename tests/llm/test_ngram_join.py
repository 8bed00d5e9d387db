"""N-gram join against brute force, and components."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import pytest

from sparkatlas.llm import ngram_join
from sparkatlas.llm.components import components

from .conftest import WORD, lower


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for a, b in {p for h in holders.values() for p in combinations(h, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)), key=lambda i: (i is None, i))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size, percent, block", [(4, 85, 1500), (4, 85, 3), (5, 80, 1500)])
def test_matches_brute_force(size, percent, block, docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, size, percent).collect()}
    assert found == brute(rows, size, percent)


def test_every_linked_pair_shares_an_entry():
    import numpy as np

    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 300)
        a = set(rng.sample(range(1 << 60), n))
        b = set(a)
        for _ in range(rng.randint(0, n // 8 + 1)):
            b.discard(rng.choice(sorted(b))) if len(b) > 1 and rng.random() < 0.5 else b.add(rng.randrange(1 << 60))
        for percent in (80, 85, 95):
            if a != b and 100 * len(a & b) >= percent * len(a | b):
                own = [set(ngram_join.entries(np.array(sorted(s), np.uint64), percent).tolist()) for s in (a, b)]
                assert own[0] & own[1]


def test_one_of_each(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(3, text, "a"), (1, text + " more", "b"), (2, "other words here and there", "c"), (2, "other words here and there", "c"), (4, None, "d"), (5, None, "e")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, kept_doc_id string"))
    assert sorted((r.doc_id, r.kept_doc_id) for r in kept.collect()) == [(1, "b"), (2, "c"), (4, "d"), (5, "e")]


def test_empty_table(no_docs):
    assert ngram_join.join(no_docs).count() == 0


def test_a_large_group_is_joined_through_blocks(spark, monkeypatch):
    """Chains, strays and one big cluster in one candidate group, cut into blocks of few sets."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(4)
    sets = []
    base = rng.sample(range(1 << 60), 60)
    for i in range(90):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 9, 12])):
            own[rng.randrange(60)] = rng.randrange(1 << 60)
        sets.append(ngram_join.np.array(sorted(set(own)), "uint64"))
    rows = [(1, bytes([i] * 16), s.tobytes()) for i, s in enumerate(sets)]
    found = ngram_join.large_links(spark.createDataFrame(rows, "grp long, sid binary, grams binary"), 80).collect()
    label = {i: i for i in range(90)}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, y in [(r.x[0], r.y[0]) for r in found]:
        label[max(find(x), find(y))] = min(find(x), find(y))
    got = [find(i) for i in range(90)]
    label = {i: i for i in range(90)}
    for i, j in combinations(range(90), 2):
        both = len(ngram_join.np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            label[max(find(i), find(j))] = min(find(i), find(j))
    assert got == [find(i) for i in range(90)] and len(set(got)) > 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 90 for i in (90, 95, 100)}
