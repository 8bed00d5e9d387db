"""Small corpora with the awkward cases, and brute-force helpers."""

from __future__ import annotations

import random
import re

import pytest

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return (text or "").translate(ASCII_LOWER)


def awkward_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, ties, copies, a long text, other scripts and a null id."""
    long = " ".join(f"w{i % 977}" for i in range(6000))
    return [(9900, None), (9901, ""), (9902, " \n\t "), (9903, "one"), (9904, "One TWO"), (9905, long), (9906, long + " end"), (9907, "é" * 400), (9908, "é" * 400 + "x"), (9909, "\n".join(["same line of words"] * 40)), (None, "a row without an id " * 20)]


def corpus(seed: int = 3) -> list[tuple[int, str]]:
    """Texts over few words, with shared passages, copies and near copies."""
    rng = random.Random(seed)
    rows: list[tuple[int, str]] = []
    few = [f"w{i}" for i in range(6)]
    for i in range(40):
        words = rng.choices(few, k=rng.randint(0, 200)) if i % 3 else [rng.choice("ab")] * rng.randint(0, 120)
        if i % 5 == 0 and i:
            words = words + rows[-1][1].split()[:120] + words
        rows.append((i, " ".join(words)))
    for i in range(40, 120):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(rng.choice([3, 5, 8, 12, 20, 40, 90]))]
        for c in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                j = rng.randrange(len(words))
                words[j : j + rng.randint(0, 1)] = [f"x{rng.randint(0, 999)}"]
            rows.append((i * 10 + c, " ".join(words)))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus() + awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with more columns, whose names clash with ones that operators use."""
    full = [(i, t, "en", "src0", len(t or ""), 1, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, th long, spans string").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
