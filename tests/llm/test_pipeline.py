"""The pipeline's stages against brute force over a small folder of tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from .conftest import WORD, lower
from .test_ngram_join import brute
from .test_texts import brute_hits

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "vo") for b in ("n", "s", "t", "l", "r", "m", "p", "d")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    shared, item = text(60), text(30)
    rows = [(i, text(rng.randint(60, 200))) for i in range(30)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + " extra"), (102, "short"), (103, "### $$$ " * 60), (104, None)]
    rows += [(110, f"{text(80)} {shared} {text(70)}"), (111, f"{text(90)}\n{shared}\n{text(60)}")]
    rows += [(120, f"{text(80)} {item} {text(60)}"), (121, f"{item} {text(25)}")]
    root = str(tmp_path_factory.mktemp("tables"))
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "kan")][:1], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, item


def test_stages(spark, folder):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    root, rows, item = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    before = dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "quality_rules":
            assert set(before) - set(after) == {102, 103, 104} and all(after[i] == before[i] for i in after)
        if name == "ngram_join":
            groups = brute(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, c) in groups.items() if c == i} and 100 not in after and 101 not in after
        if name == "substring_dedup":
            seen = Counter(tuple(w[j : j + 35]) for w in map(str.split, before.values()) for j in range(len(w) - 34))
            for i, t in before.items():
                w = t.split()
                gone = {j + k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(35)}
                assert after[i].split() == [x for j, x in enumerate(w) if j not in gone]
            assert len(after[110].split()) == 150
        if name == "decontaminate":
            for i, t in before.items():
                n, hit, _ = brute_hits(t, [(1, item)], 10)
                assert (i in after) == (hit <= 0.5 * n)
                if i in after:
                    assert brute_hits(after[i], [(1, item)], 30)[1] == 0 and len(WORD.findall(lower(after[i]))) == n - hit
        before = after
    last = corpus_pipeline.run(spark, root)
    assert {r.doc_id: r.decoded.replace("</w>", "").replace(" ", "") for r in last.collect()} == {i: lower(t).replace(" ", "").replace("\n", "") for i, t in before.items()}
