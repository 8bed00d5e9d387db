"""Fingerprints window by window, the match guarantee, and neighbours in order of ids."""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import numpy as np
import pytest

from sparkatlas.llm import winnowing
from sparkatlas.llm.textcore import Spans, mix


@lru_cache(maxsize=None)
def hash_of(gram):
    points = np.array([ord(c) for c in gram], np.uint64)
    return int(Spans(mix(points + np.uint64(1)))(np.array([0]), np.array([len(points)]))[0] >> np.uint64(32))


def hashes_of(text, gram):
    """32-bit hash of each gram, worked out one at a time."""
    return [hash_of(text[i : i + gram]) for i in range(max(1, len(text) - gram + 1))]


@lru_cache(maxsize=None)
def brute(text, gram, window):
    if not text:
        return []
    hashes = hashes_of(text, gram)
    kept = set()
    for i in range(max(1, len(hashes) - window + 1)):
        own = hashes[i : i + window]
        kept.add(max(j for j in range(i, i + len(own)) if hashes[j] == min(own)))
    return [(hashes[j], j) for j in sorted(kept)]


def texts_of(seed=1):
    rng = random.Random(seed)
    out = ["", "a", "abc", "aaaaaaaa", "a" * 200, "ab" * 90, "é𝄞" * 40, "x" * 31, "y" * 32]
    out += ["".join(rng.choices("abc d", k=rng.randint(0, 150))) for _ in range(40)]
    return out


@pytest.mark.parametrize("gram,window", [(8, 24), (3, 4), (1, 1), (5, 1)])
def test_fingerprints(gram, window):
    texts = texts_of()
    got = winnowing.fingerprints(texts, gram, window)
    for t, (hashes, at) in zip(texts, got):
        assert list(zip(hashes.tolist(), at.tolist())) == brute(t, gram, window), t
    assert [x.tolist() for p in got for x in winnowing.read_back(winnowing.written_out(p))] == [x.tolist() for p in got for x in p]
    assert winnowing.fingerprints([]) == []


def test_shared_passages_leave_a_common_hash():
    rng = random.Random(9)
    for _ in range(60):
        passage = "".join(rng.choices("abcdef ", k=winnowing.GRAM + winnowing.WINDOW - 1))
        two = ["".join(rng.choices("uvwxyz ", k=rng.randint(0, 90))) + passage + "".join(rng.choices("uvwxyz ", k=rng.randint(0, 90))) for _ in range(2)]
        a, b = winnowing.fingerprints(two)
        assert set(a[0].tolist()) & set(b[0].tolist())


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        e = winnowing.edited(t, n)
        a, b, c = (brute(x, winnowing.GRAM, winnowing.WINDOW) for x in (t, e, n))
        near = [1.0 if not x and not y else len(x & y) / len(x | y) for x, y in (({h for h, _ in a}, {h for h, _ in o}) for o in (b, c))]
        text = ["".join(f"{h:08x}{p:08x}" for h, p in x) for x in (a, b)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *text, *near))
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edited():
    assert winnowing.edited("abcdefgh", "XYZ") == "abcdefXY"
    assert winnowing.edited("abcdefgh", "X") == "abcdefX"
    assert winnowing.edited("abc", "XYZ") == "abc"


@pytest.mark.parametrize("range_docs", [4, 1 << 11])
def test_compare(docs, rows, range_docs):
    assert answer(winnowing.compare(docs, range_docs=range_docs)) == expected(rows)


def test_repeats_short_ids_and_one_document(spark):
    rows = [(5, "b" * 40), (5, "a" * 50), (5, None), (2, "c d " * 30), (9, "b" * 40)] * 2
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    assert answer(winnowing.compare(docs, range_docs=2)) == expected(rows)
    one = [(1, "the only one " * 9)]
    assert answer(winnowing.compare(spark.createDataFrame(one, "doc_id long, text string"))) == expected(one)


def test_empty_table(no_docs):
    assert winnowing.compare(no_docs).count() == 0


def test_slices_carry_over(docs, rows, monkeypatch):
    monkeypatch.setattr(winnowing, "SLICE_CHARS", 500)
    assert answer(winnowing.compare(docs)) == expected(rows)


def test_fingerprint_documents(docs, rows):
    got = {(r.doc_id, r.n_chars, r.fingerprint) for r in winnowing.fingerprint_documents(docs).collect()}
    assert got == {(i, n, f) for i, n, _, f, *_ in expected(rows)}


def test_long_text(spark):
    long = " ".join(f"w{i % 7001}" for i in range(120_000))
    got = {r.doc_id: r for r in winnowing.compare(spark.createDataFrame([(1, long), (2, long + "!")], "doc_id long, text string")).collect()}
    assert got[1].near_next > 0.99 and got[1].n_chars == len(long)
    assert got[1].edited_sha256 == hashlib.sha256(winnowing.edited(long, long + "!").encode()).hexdigest()
