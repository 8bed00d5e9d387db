"""BPE, decontamination, licences, rules and shards against references and brute force."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter

import pytest

from sparkatlas.llm import bpe, decontaminate, licenses, quality_rules, sharding

from .conftest import CLEAN_WORD, WORD, lower


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")


def test_long_words_match_the_library(vocabulary):
    import time

    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(vocabulary), bpe.Codec(json.load(open(vocabulary, encoding="utf-8")))
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (1023, 1024, 1025, 5000)] + ["a" * 3001, "é" * 2000, "abc" * 1500]
    for word, ids in zip(words, codec.encode(words)):
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids
    began = time.perf_counter()
    codec.encode(["".join(rng.choices("etaoinshrdlu", k=200_000))])
    assert time.perf_counter() - began < 10


def test_bpe_matches_the_library(vocabulary, rows):
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(vocabulary), bpe.Codec(json.load(open(vocabulary, encoding="utf-8")))
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(0x250), 0x3A3, 0x3C2, 0x130, 0x1E9E, 0x212A, 0x301, 0x308, 0xAC00, 0x4E00, 0x1F600, 0x200D, 0x2028, 0x3000, 0xFB01, 0x2460, 0x660]]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(500)] + ["aaaaaaaa", "<|endoftext|>a<|startoftext|>", "I'LL 'S we've"] + [t or "" for _, t in rows]
    for text, ids in zip(texts, codec.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_documents(vocabulary, docs, rows, no_docs):
    out = {r.doc_id: r for r in bpe.digest_documents(docs, vocabulary).collect()}
    full = bpe.encode_documents(docs, vocabulary)
    assert {r.doc_id: (sha(bytes(r.ids)), sha(r.decoded.encode())) for r in full.collect()} == {i: (r.ids_sha256, r.decoded_sha256) for i, r in out.items()}
    assert {r.doc_id: sha(r.text.encode()) for r in bpe.decode_documents(full, vocabulary).collect()} == {i: r.decoded_sha256 for i, r in out.items()}
    assert len(out) == len(rows) and out[9900].n_tokens == 0 and bpe.digest_documents(no_docs, vocabulary).count() == 0


# decontamination

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, "Zeta eta theta iota kappa lambda mu nu xi omicron pi"), (5, "solo"), (6, "short item"), (None, "nameless one here")]
TEXTS = ["x alpha beta gamma delta epsilon zeta eta theta iota kappa y", "ALPHA, beta; gamma delta epsilon zeta eta theta iota nope", "a short-item and solo", "eta theta iota kappa lambda mu nu xi omicron pi rho " * 3, "", None, "nameless one here", "alpha " * 300]


def brute_hits(text, items, window):
    words, hit, found = CLEAN_WORD.findall(lower(text)), set(), set()
    for item, t in items:
        w = CLEAN_WORD.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[k : k + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(words), len(hit), sorted(found - {None}, key=str)


@pytest.mark.parametrize("block_words", [500_000, 12])
@pytest.mark.parametrize("items", [ITEMS, [ITEMS[0], ITEMS[3]], []])
def test_decontamination(spark, items, block_words):
    table = spark.createDataFrame(items, "item_id long, text string")
    rng = random.Random(9)
    texts = TEXTS + [" ".join(rng.choices(ITEMS[0][1].split() + ["short", "item", "solo"], k=60)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in decontaminate.find_hits(docs, table, block_words=block_words).collect():
        assert (r.n_words, sum(r.ends) - sum(r.starts), sorted(r["items"], key=str)) == brute_hits(texts[r.doc_id], items, 10)
    for r in decontaminate.digest(docs, table).collect():
        n, hit, found = brute_hits(texts[r.doc_id], items, 10)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == sha(",".join(sorted(map(str, found))).encode())


def test_decontaminated_texts(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    leak = ITEMS[0][1]
    rows = [(1, f"Kept before.\n{leak}! And much more text is kept after it, as it was, with all its words."), (2, leak + " end"), (3, None), (4, "clean  text\n")]
    out = decontaminate.decontaminate(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, items string"), items)
    assert {r.doc_id: (r.text, r["items"]) for r in out.collect()} == {1: ("Kept before.\n! And much more text is kept after it, as it was, with all its words.", "c"), 3: (None, "c"), 4: ("clean  text\n", "c")}
    assert decontaminate.digest(no_docs, items).count() == 0 and decontaminate.digest(docs, items).where("contaminated").count() == 0


# licences


def test_licences(spark, docs, no_docs):
    texts = ["Released under the MIT License.", "mit licensed; MIT license", "Licensed under the Apache License, Version 2.0.", "GNU General Public License and general public license", "Licensed under CC BY-NC 4.0", None, "", "license permission rights", "All rights reserved. Copyright 2020.", "x " * 3000 + "Copyright: all rights reserved", "MIT License. Licensed under the Apache License, Version 2.0"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(frame)).collect()}
    for i, t in enumerate(texts):
        w = CLEAN_WORD.findall(lower(t))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None)) and 0 <= r.score <= 1
    assert [got[i].labels for i in (0, 2, 4, 9, 10)] == ["mit", "apache,apache-2.0", "cc-by-nc-4.0", "reserved", "apache,apache-2.0,mit"]
    assert licenses.scan(no_docs).count() == 0 and licenses.scan(docs).count() == docs.count()


def test_several_licences_in_one_text(spark):
    rng = random.Random(4)
    texts = [t.text for t in licenses.TEMPLATES]
    joined = [" ".join(texts), *(" filler words ".join(rng.sample(texts, k)) for k in (2, 3, 3, 5, 8)), " ".join(rng.choices(" ".join(texts).split(), k=3000)) + " " + " ".join(texts)]
    rows = [*enumerate(joined), *((i, "nothing of the kind in here") for i in range(100, 140))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    idf = licenses.word_idf(frame)
    got = {r.doc_id: {(x.label, x.start) for x in r.found} for r in licenses.scan(frame, idf=idf).collect()}
    for i, text in rows:
        w, want = text.split(), set()
        for t in licenses.TEMPLATES:
            own, key = t.text.split(), t.key.split()
            off = next(p for p in range(len(own)) if own[p : p + len(key)] == key)
            for at in range(-len(own), len(w)):
                here = [w[at + p] if 0 <= at + p < len(w) else None for p in range(len(own))]
                score = sum(idf[x] for x, y in zip(own, here) if x == y) / sum(idf[x] for x in own)
                if here[off : off + len(key)] == key and score >= licenses.MIN_SCORE:
                    want.add((t.label, at))
        assert got[i] == want
    assert {x for x, _ in got[0]} >= {t.label for t in licenses.TEMPLATES}


# quality rules


def test_quality_rules(docs, rows, no_docs):
    texts = dict(rows) | {}
    entries = quality_rules.stored_ledger(docs)
    out = quality_rules.apply_policy(entries)
    kept = quality_rules.keep(docs, entries=entries)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out.where("kept").collect())
    for r in out.collect():
        text = texts[r.doc_id] or ""
        words = WORD.findall(text)
        tri = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if tri[t] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in quality_rules.SYMBOLS for c in text)
        failed = {b for b in quality_rules.RULES if r.fail_bits >> b & 1}
        assert (0 in failed) == (len(words) < 50) and r.kept == (not failed & {b for b in quality_rules.RULES if quality_rules.STANDARD.mask >> b & 1})
    assert quality_rules.ledger(no_docs).count() == 0


def test_kept_documents_keep_clashing_columns(spark):
    good = " ".join(f"word{i}" for i in range(60))
    names = "doc_id long, text string, kept string, fail_bits string, n_words string, policy string, words string, kept_doc_id string, TH string"
    docs = spark.createDataFrame([(1, good, *"abcdefg"), (1, "short", *"abcdefg"), (None, good, *"abcdefg"), (None, None, *"abcdefg")], names)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, good, *"abcdefg"), (None, good, *"abcdefg")]))


def test_ablation(spark):
    entries = spark.createDataFrame([(0b0,), (0b1,), (0b11,), (0b10,), (0b10,)], "fail_bits long")
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality_rules.ablation(entries, quality_rules.Policy("t", 0b11)).collect()}
    assert got == {"min_words": (2, 1, 2), "repeated_windows": (3, 2, 3)}


# shards


def test_sharding(docs, rows, no_docs):
    out = sharding.shard_documents(docs, 3).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for s in range(3):
        own = [r.slot for r in out if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(3)]
    assert max(sizes) - min(sizes) <= max(r.size for r in out)
    assert sharding.shard_documents(no_docs).count() == 0


def test_the_newest_map_is_edited(docs, spark, tmp_path):
    path = str(tmp_path / "map")
    first = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard_documents(docs, 3, path=path).collect()}
    again = sharding.shard_documents(docs, 3, path=path).collect()
    assert {(r.doc_id, r.text_crc32): r.shard for r in again} == first and {r.map_version for r in again} == {2}
    grown = sharding.shard_documents(docs, 4, path=path).collect()
    assert {r.map_version for r in grown} == {3} and {r.shard for r in grown} == set(range(4)) and sharding.versions(spark, path) == [1, 2, 3]
    changes = sharding.changes(spark, path).collect()
    assert all(r.moved == (r.before != r.after) for r in changes) and 0 < sum(r.moved for r in changes) < len(changes)


def test_rebalancing_moves_few_slots():
    rng = random.Random(2)
    slots = [sharding.Slot(i, rng.randint(900, 1100), 10) for i in range(1000)]
    first = sharding.plan(slots, 8)
    grown = sharding.rebalance(first, slots, 9)
    moved = [a for a, b in zip(sorted(first, key=lambda s: s.slot), sorted(grown, key=lambda s: s.slot)) if a.shard != b.shard]
    loads = Counter()
    for s in grown:
        loads[s.shard] += s.bytes
    assert len(grown) == 1000 and len(moved) < 1000 / 9 * 1.3 and max(loads.values()) < 1.06 * min(loads.values())
