"""The registered queries over the whole smallest tables, by their contracts, against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sparkatlas.llm import licenses
from sparkatlas.llm.queries import ORACLES, QUERIES

from .conftest import CLEAN_WORD, WORD, lower
from .test_ngram_join import brute
from .test_repeats import brute_passages, brute_strings
from .test_winnowing import expected as fingerprints

DATA = "/root/testdata/sf0.001"

if not os.path.isdir(DATA):
    pytest.skip("the tables are not there", allow_module_level=True)


def read(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{DATA}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return dict(read("documents", "doc_id, text"))


def answer(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def remainder(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op1(spark, texts):
    words = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    c = Counter(w for i, own in words.items() if remainder(i, 5) != 1 for w in own)
    n, v = sum(c.values()), len(c)
    got = answer(spark, "op1_gated_lm")
    assert got.keys() == texts.keys()
    for i, own in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 5) == 1, len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op2(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    got = answer(spark, "op2_bpe")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode()))


@pytest.mark.parametrize(
    "name, truth",
    [
        ("op3_ngram_join", lambda rows: brute(rows, 4, 85)),
        ("op4_substring_dedup", lambda rows: brute_passages(rows, 35)),
        ("op7_suffix_array_dedup", lambda rows: brute_strings(rows, 100)),
    ],
)
def test_whole_rows(spark, texts, name, truth):
    assert {i: tuple(r)[1:] for i, r in answer(spark, name).items()} == truth(list(texts.items()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, DATA).collect()) == want and want


def test_op6(spark, texts):
    window, windows = 10, defaultdict(set)
    for item, t in read("benchmark", "item_id, text"):
        words = CLEAN_WORD.findall(lower(t))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[k : k + size])].add(item)
    sizes = {len(w) for w in windows}
    got = answer(spark, "op6_decontaminate")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words, hit, items = CLEAN_WORD.findall(lower(t)), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if found := windows.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    items |= found
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(items), bool(hit))
        assert r.items_sha256 == sha(",".join(sorted(map(str, items))).encode())
    assert any(r.contaminated for r in got.values())


def test_op8(spark, texts):
    got = answer(spark, "op8_sharding")
    assert got.keys() == texts.keys()
    shards = defaultdict(list)
    for i, r in got.items():
        raw = (texts[i] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(8))
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
    sizes = [sum(r["size"] for r in own) for own in shards.values()]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in got.values())


def test_op9(spark, texts):
    labels = {i: q for i, q in read("labels", "doc_id, quality")}
    got = answer(spark, "op9_crf_quality")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (remainder(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r.predicted == labels[i] for i, r in got.items() if r.held_out and i in labels]
    assert held and sum(held) >= 0.9 * len(held)


def test_op10(spark, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    assert licenses.BASE == phrases
    got = answer(spark, "op10_licenses")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        text = " " + " ".join(words := CLEAN_WORD.findall(lower(t))) + " "
        places = sorted((text[: m.start() + 1].count(" ") - 1, label) for p, label in phrases.items() for m in re.finditer(f"(?= {p} )", text))
        r = got[i]
        base = ",".join(sorted({x for _, x in places}))
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), base)
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert {x for x in base.split(",") if x} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base for r in got.values())


def test_op12(spark, texts):
    got = QUERIES["op12_fingerprints"](spark, DATA).collect()
    assert sorted((tuple(r) for r in got), key=str) == fingerprints(list(texts.items()))
    near = [r for r in got if r.n_chars >= 40]
    assert sum(r.near_edited > 0.3 for r in near) >= 0.95 * len(near)
