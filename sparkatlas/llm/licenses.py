"""License scans by a positional index of rare licence words.

Templates are short licence statements. The index holds the words of highest
IDF (over all documents) of each template's mandatory key phrase, with the
templates and places that have them. Every place of such a word in a document
is looked up; postings that agree on where a template would begin are
intersected; each placement left is scored by the IDF of the template words
found in place, and counts once the key phrase stands there word for word. As
it must stand there, no placement that counts is missed, however many licences
a document holds.

DataFrame functions only; everything about one document happens in its row.
Only documents with the letters of a gate word (every key phrase and every
base phrase has one) are looked at word by word, which loses nothing.

Defined cases: a null or empty text has no words, places or labels and scores
0; ties in IDF go by the word; repeated rows are separate documents; very long
texts are scanned whole; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm.common import ascii_lower, text_of

#: Words before A-Z are lower-cased, and what parts them.
RAW_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrase -> label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    """A licence statement: its label, its words, and the key phrase that must stand in place."""

    label: str
    text: str
    key: str


TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "licensed under cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "licensed under cc by sa 4 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "licensed under cc by 4 0"),
    Template("cc0", "to the extent possible under law all copyright and related rights are waived cc0", "copyright and related rights"),
    Template("reserved", "copyright all rights reserved", "all rights reserved"),
)
#: Letters of which every key phrase and base phrase has some.
GATES = ("license", "permission", "redistribution", "copyright", "rights")
#: Words of each key phrase in the index, of which two must agree.
RARE_WORDS = 2
MIN_SCORE = 0.6


def _gated(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for gate in GATES:
        out = out | F.contains(low, F.lit(gate))
    return out


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def licence_words(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def key_place(template: Template) -> int:
    """The key phrase's place in the template."""
    own, key = template.text.split(), template.key.split()
    return next((p for p in range(len(own)) if own[p : p + len(key)] == key), 0)


def word_idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of each template word over all documents: a table as long as the templates' vocabulary.

    A word's documents are those whose text holds it as a word. Sums of 0 and 1
    per word, added up before anything is shuffled.
    """
    vocab = licence_words(templates)
    words = F.array_distinct(F.split(ascii_lower(F.col("text")), PARTS))
    found = docs.where("text IS NOT NULL").select(F.explode(F.array_intersect(words, _strings(vocab))).alias("w"))
    counts = {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) for w in vocab}


def _lookup(values: dict[str, Column], word: Column, default: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), word), default)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, idf: dict[str, float] | None = None, rare_words: int = RARE_WORDS, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_words, base places (phrase label and start word) and placements of templates (label, start word, score)."""
    for need in [*BASE, *(t.key for t in templates)]:
        if not any(g in need for g in GATES):
            raise ValueError(f"{need!r} has no gate word")
    idf = idf if idf is not None else word_idf(docs, templates)
    low = text_of()
    count = F.regexp_count(low, F.lit(RAW_WORDS)).cast("long")
    words = F.when(_gated(low), F.array_remove(F.split(ascii_lower(low), PARTS), "")).otherwise(F.array().cast("array<string>"))
    out = docs.select("doc_id", count.alias("n_words"), words.alias("_w"))

    def at(i: Column, k: int) -> Column:
        return F.get("_w", i + k)

    def stands(i: Column, phrase: list[str]) -> Column:
        test = at(i, 0) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            test = test & F.coalesce(at(i, k) == w, F.lit(False))
        return test

    licence = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(licence_words(templates)))
    out = out.withColumn("_m", licence)

    def base_at(x: Column) -> Column:
        kinds = [F.when(stands(x["i"], p.split()), F.lit(label)) for p, label in BASE.items()]
        return F.struct(F.coalesce(*kinds).alias("label"), x["i"].alias("start"))

    starts = sorted({p.split()[0] for p in BASE})
    out = out.withColumn("base", F.filter(F.transform(F.filter("_m", lambda x: x["w"].isin(starts)), base_at), lambda x: x["label"].isNotNull()))
    entries: dict[str, list[tuple[int, int]]] = {}
    for t, tpl in enumerate(templates):
        key = tpl.key.split()
        rarest = sorted(range(len(key)), key=lambda p: (-idf.get(key[p], 0.0), p))[: max(rare_words, 2)]
        for p in rarest if len(key) > 1 else [0, 0]:
            entries.setdefault(key[p], []).append((t, key_place(tpl) + p))
    postings = {w: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in found]) for w, found in entries.items()}
    none = F.array().cast("array<struct<t:int,p:int>>")
    begin = lambda x: F.transform(_lookup(postings, x["w"], none), lambda y: F.struct(y["t"].alias("t"), (x["i"] - y["p"]).alias("at")))
    out = out.withColumn("_all", F.sort_array(F.flatten(F.transform(F.filter("_m", lambda x: x["w"].isin(sorted(entries))), begin))))
    # placements on which two or more rare words agree: equal neighbours once sorted
    agree = F.array_distinct(F.filter("_all", lambda x, i: F.coalesce(x == F.get("_all", i - 1), F.lit(False))))
    out = out.withColumn("_cand", agree)

    def judged(x: Column) -> Column:
        scores, labels, ok = [], [], []
        for t, tpl in enumerate(templates):
            own = tpl.text.split()
            full = sum(idf[w] for w in own) or 1.0
            got = F.lit(0.0)
            for p, w in enumerate(own):
                got = got + F.when(at(x["at"], p) == w, F.lit(idf[w])).otherwise(0.0)
            key = tpl.key.split()
            scores.append(F.when(x["t"] == t, F.round(got / full, 6)))
            ok.append(F.when(x["t"] == t, stands(x["at"] + key_place(tpl), key)))
            labels.append(F.when(x["t"] == t, F.lit(tpl.label)))
        return F.struct(F.coalesce(*labels).alias("label"), x["at"].alias("start"), F.coalesce(*scores).alias("score"), F.coalesce(*ok, F.lit(False)).alias("ok"))

    placed = F.filter(F.transform("_cand", judged), lambda x: x["ok"] & (x["score"] >= min_score))
    return out.select("doc_id", "n_words", "base", F.transform(placed, lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["score"].alias("score"))).alias("found"))


def summary(scanned: DataFrame) -> DataFrame:
    """Per document the base places, labels and best score."""
    own = F.transform("found", lambda x: x["label"])
    base = F.transform("base", lambda x: x["label"])
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("base") > 0, F.greatest(best, F.lit(0.5))).otherwise(best).alias("score"),
    )
