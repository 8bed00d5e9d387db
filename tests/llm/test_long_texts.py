"""Texts of more than 10^5 words through the operators that read whole texts."""

from __future__ import annotations

import pytest

from sparkatlas.llm import crf_quality, decontaminate, gated_lm, licenses, ngram_join, substring_dedup, suffix_array_dedup

N = 120_000


@pytest.fixture(scope="module")
def long():
    return " ".join(f"w{i}" for i in range(N))


@pytest.fixture(scope="module")
def docs(spark, long):
    rows = [(1, long), (2, long + " mit license"), (3, "a short text of its own")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_ngram_join(docs):
    got = by_id(ngram_join.join(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {1: (N - 3, 1), 2: (N - 1, 1), 3: (3, 3)}


def test_substring_dedup(docs):
    got = by_id(substring_dedup.digest(docs))
    assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {1: (N, N), 2: (N + 2, N), 3: (6, 0)}


def test_suffix_array_dedup(docs, long):
    got = by_id(suffix_array_dedup.digest(docs))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans) for i, r in got.items()} == {1: (len(long), 0, 0), 2: (len(long) + 12, len(long), 1), 3: (23, 0, 0)}


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(7, " ".join(f"W{i}" for i in range(90_000, 90_012)))], "item_id long, text string")
    got = by_id(decontaminate.digest(docs, items))
    assert {i: (r.n_words, r.n_hit, r.n_items) for i, r in got.items()} == {1: (N, 12, 1), 2: (N + 2, 12, 1), 3: (6, 0, 0)}


def test_licenses(docs):
    got = by_id(licenses.summary(licenses.scan(docs)))
    assert {i: (r.n_words, r.n_base, r.first_word, r.base_labels) for i, r in got.items()} == {1: (N, 0, None, ""), 2: (N + 2, 1, N, "mit"), 3: (6, 0, None, "")}


def test_crf_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    got = by_id(crf_quality.score(docs, crf_quality.train(docs, labels)))
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got.values())


def test_gated_lm(docs):
    got = by_id(gated_lm.score(docs))
    assert {i: r.n_tokens for i, r in got.items()} == {1: N + 1, 2: N + 3, 3: 7} and all(r.score < 0 for r in got.values())
