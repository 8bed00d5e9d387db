"""Substring and suffix-array dedup against brute force."""

from __future__ import annotations

import dataclasses
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkatlas.llm import repeats, substring_dedup, suffix_array_dedup


def brute_passages(rows, length):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[j : j + length]) for _, w in words for j in range(len(w) - length + 1))
    out = {}
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - length + 1):
            if seen[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = True
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def brute_strings(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - length + 1):
            if raw[j : j + length] in seen:
                gone[j : j + length] = True
            seen.add(raw[j : j + length])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("changes", [{}, {"common": 1}, {"hot": 0, "often": 2}, {"common": 1, "hot": 0, "often": 2}])
@pytest.mark.parametrize("module, brute, length", [(substring_dedup, brute_passages, 35), (suffix_array_dedup, brute_strings, 100)])
def test_matches_brute_force(module, brute, length, changes, docs, rows, monkeypatch):
    # common: triggers go window by window; hot: frequent ones are salted
    unit = module.unit
    monkeypatch.setattr(module, "unit", lambda n: dataclasses.replace(unit(n), **changes))
    found = {r[0]: tuple(r)[1:] for r in module.digest(docs).collect()}
    assert found == brute(rows, length)


def test_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.digest(docs).collect()) == [(1, 80), (1, 80), (2, 0)]
    assert all(r.n_removed == 0 for r in suffix_array_dedup.digest(docs).collect())


def test_empty_table(no_docs):
    assert substring_dedup.digest(no_docs).count() == 0
    assert suffix_array_dedup.digest(no_docs).count() == 0


def test_cut_keeps_other_text_and_columns(spark):
    shared = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"a\n  b {shared}\nc", "x"), (2, f"{shared} d\te", "y"), (3, "left  as\nit is", "z")], "doc_id long, text string, th string")
    out = {r.doc_id: (r.text, r.th) for r in substring_dedup.remove_passages(docs).collect()}
    assert out == {1: ("a\n  b c", "x"), 2: ("d\te", "y"), 3: ("left  as\nit is", "z")}


def test_matching_statistics():
    bodies = [b"a b c d e".split(), b"x b c d y".split()]
    first, second = substring_dedup.matching_statistics(bodies, np.array([0, 1 << 32]))
    assert first.tolist() == [0, 1, 2, 3, 0] and second.tolist() == [0, 1, 2, 3, 0]


def test_equal_strings():
    starts, kind = suffix_array_dedup.equal_strings([b"abcdefghijklmnopqrstuvwxyz" * 3, b"qrstuvwxyzabcdefghij"], 12)
    text = b"abcdefghijklmnopqrstuvwxyz" * 3 + b"qrstuvwxyzabcdefghij"
    strings = [text[s : s + 12] for s in starts]
    assert len(set(zip(kind.tolist(), strings))) == len(set(strings)) == len(set(kind.tolist()))


def test_equal_strings_at_random():
    rng = np.random.default_rng(5)
    for length in (3, 9, 30):
        for _ in range(30):
            base = bytes(rng.integers(97, 99 + rng.integers(0, 20), 200, dtype=np.uint8))
            texts = [base[a : a + length + rng.integers(0, 60)] for a in rng.integers(0, 100, 8)]
            starts, kind = suffix_array_dedup.equal_strings(texts, length)
            strings = [b"".join(texts)[s : s + length] for s in starts.tolist()]
            assert len(strings) == sum(len(t) - length + 1 for t in texts)
            assert len(set(zip(kind.tolist(), strings))) == len(set(strings)) == len(set(kind.tolist()))


def test_suffix_ranks():
    rng = np.random.default_rng(2)
    sequences = [bytes(rng.integers(1, 3, n, dtype=np.uint8)) for n in (1, 5, 40, 40, 17)]
    suffixes = [s[i:][:12] for s in sequences for i in range(len(s))]
    sizes = np.array([len(s) for s in sequences])
    ranks = suffix_array_dedup.suffix_ranks(np.frombuffer(b"".join(sequences), np.uint8), np.repeat(np.cumsum(sizes), sizes), 12)
    assert ranks.tolist() == [sorted(set(suffixes)).index(s) + 1 for s in suffixes]


def test_clashing_columns(spark):
    shared = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"a {shared}", 7, "x"), (2, f"{shared} b", 8, "y")], "doc_id long, text string, spans int, spans_th string")
    assert sorted(map(tuple, substring_dedup.remove_passages(docs).collect())) == [(1, "a ", 7, "x"), (2, "b", 8, "y")]


def test_copies_are_compared_by_the_automaton(spark):
    """A context known twice by its hash goes only if the texts of two places agree."""
    same, other = " ".join(f"s{i}" for i in range(36)), " ".join(f"o{i}" for i in range(36))
    rows = [(1, 10, 5, 7, 2, 0, same, False), (2, 20, 5, 7, 0, 3, same, False), (3, 30, 6, 8, 2, 0, same + " x", False), (4, 40, 6, 8, 0, 0, other + " x", False)]
    sent = spark.createDataFrame(rows, "doc_id long, th long, route long, more long, copies long, lo int, body string, common boolean").withColumn("body", F.encode("body", "utf-8"))
    unit = substring_dedup.unit(35)
    for shard_bytes in (1, 10_000):
        out = repeats.compared(sent, unit, substring_dedup.compare(35), shard_bytes, skip_copied=True).collect()
        assert [tuple(r) for r in out] == [(6, 8, repeats.REFUTED, repeats.REFUTED)]


@pytest.mark.parametrize("cuts", [[6], [1, 5], [2, 4], [3, 3], [1, 1, 1, 1, 1, 1]])
def test_two_places_of_a_copied_context_are_sent(cuts):
    """However the sorted rows fall into batches."""
    names = ["doc_id", "th", "lo", "n", "trigger", "context"]
    table = pa.table([pa.array(c) for c in zip(*[(1, 1, 0, 3, 5, 1), (2, 2, 0, 3, 5, 1), (3, 3, 0, 3, 5, 1), (4, 4, 0, 3, 6, 1), (5, 5, 0, 3, 7, 1), (6, 6, 0, 3, 7, 1)])], names=names)
    runs, out, at = repeats.Runs(substring_dedup.unit(35), False, []), [], 0
    for size in cuts:
        out += [r for b in runs.add(table.slice(at, size)) for r in b.to_pylist()]
        at += size
    out += [r for b in runs.add(runs.held.slice(0, 0), last=True) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["copies"]) for r in out if r["sent"]) == [(1, 3), (2, 0), (5, 2), (6, 0)]
    assert sorted(r["doc_id"] for r in out if not r["sent"]) == [1, 2, 3, 5, 6]
