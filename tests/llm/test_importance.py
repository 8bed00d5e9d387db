"""Importance resampling against brute force, and the merge of its runs."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from sparkatlas.llm import importance

from .conftest import CLEAN_WORD, lower


def brute(rows, target, percent, min_words, buckets, longest=1):
    """(doc_id, n_features, weight, score, rank) of each row; equal rows in any order."""

    def places(text):
        words = CLEAN_WORD.findall(lower(text))
        features = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % buckets for f in features]

    own = [(i, *places(t)) for i, t in rows]
    s, t = Counter(p for _, _, ps in own for p in ps), Counter(p for x in target for p in places(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for i, n, ps in own:
        weight = sum(gain[p] for p in ps) // len(ps) if ps else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(ps), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(order[: len(order) * percent // 100], 1):
        r[5] = rank
    return sorted(((i, f, w, s, r) for i, _, f, w, s, r in out), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


TARGET = ["w1 w2 a1 b7 same line of words", "é w3", None, ""]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, t, "x") for t in TARGET], "item_id long, text string, rank string")


@pytest.mark.parametrize("percent,longest", [(10, 1), (100, 1), (37, 3), (0, 1)])
def test_resample(docs, rows, target, percent, longest):
    got = importance.resample(docs, target, percent=percent, min_words=20, buckets=501, longest=longest)
    assert answer(got) == brute(rows, TARGET, percent, 20, 501, longest)


def test_repeated_rows_and_short_ids(spark, target):
    rows = [(7, "a b c " * 10)] * 900 + [(i, f"a b w{i} " * 8) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    assert answer(importance.resample(docs, target, percent=50)) == brute(rows, TARGET, 50, 20, 10_000)


def test_long_text(spark, target):
    rows = [(1, " ".join(f"w{i % 5003}" for i in range(200_000))), (2, "x " * 30)]
    assert answer(importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, percent=100)) == brute(rows, TARGET, 100, 20, 10_000)


def test_empty(docs, no_docs, target, rows):
    assert importance.resample(no_docs, target).count() == 0
    assert answer(importance.resample(docs, target.limit(0), buckets=97)) == brute(rows, [], 10, 20, 97)


def test_small_runs_blocks_and_pieces(spark):
    """Many runs and pieces, one score with a third of the rows; the draw ends inside a piece."""
    rng = random.Random(5)
    rows = [(n, 5 if n % 3 == 0 else rng.randint(-40, 40), rng.choice([None, 1, 2, 3, n])) for n in range(3000)]
    table = spark.createDataFrame(rows, "row long, score long, doc_id long").repartition(6)
    got = {r.row: r.rank for r in importance.ranks(table, 2222, run_size=128, block=8, piece=64).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[0]))
    assert got == {r[0]: rank for rank, r in enumerate(order[:2222], 1)}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_tournament(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 20))) for _ in range(k)]
    assert list(importance.merged(map(iter, runs))) == sorted(x for r in runs for x in r)
