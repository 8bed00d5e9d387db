"""Substring dedup by suffix automata of reference shards.

Passages of ``length`` words that occur anywhere else go, every copy of them.
``repeats`` finds where a passage may recur and sends each distinct context
once to a shard of bounded size. Each shard's contexts make one generalised
suffix automaton; the states that its contexts pass as they are inserted give, at
every word, the longest match that also ends at another place of the corpus
(the matching statistic). A context that recurs as a whole is sent from two of
its places; its copies go where the matching statistics of the first cover it
whole. Further copies of it, and windows at the edge of a very common passage,
are known from 128 bits of hash.
Maximal spans of matches at or above the length are removed.

A plain broadcast of every shard to every document would cost documents times
shards, so a shard meets only the documents whose triggers lead to it.

Defined cases: null and empty texts have no words; of repeated rows (same id
and text, ties of doc_id with other texts included) each counts as a copy, so
their passages go; documents shorter than the length lose nothing; very long
texts are handled whole; an empty table gives an empty result; extra columns
keep their values in ``remove_passages``, whatever their names, and are ignored
by ``digest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkatlas.llm.automaton import SuffixAutomaton
from sparkatlas.llm.common import with_text
from sparkatlas.llm.repeats import SLICE_BYTES, Unit, covered, repeated_spans, with_spans
from sparkatlas.llm.textcore import slices
from sparkatlas.llm.textcore import words as words_of

LENGTH = 35
SHARD_BYTES = 600_000
_LAST = np.iinfo(np.int64).max


def unit(length: int = LENGTH) -> Unit:
    return Unit("words", length, max(1, length // 3), common=512, verify=True)


def matching_statistics(bodies: list[list[bytes]], place: np.ndarray) -> list[np.ndarray]:
    """Per word the longest match ending there that also ends at another place.

    place: number of each body's first word; the words after it follow.
    """
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    automaton = SuffixAutomaton()
    states = [automaton.insert([number(w, len(numbers)) for w in body]) for body in bodies]
    sizes = np.array([len(s) for s in states], np.int64)
    at = np.fromiter((s for own in states for s in own), np.int64, int(sizes.sum()))
    ends = np.repeat(place - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(at))
    link, length = np.array(automaton.link), np.array(automaton.length)
    first, last = np.full(len(link), _LAST), np.full(len(link), -1)
    np.minimum.at(first, at, ends)
    np.maximum.at(last, at, ends)
    order = np.argsort(length, kind="stable")[::-1]
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for level in np.split(order, cuts):  # longest first, so that a state is complete before its link takes it over
        level = level[link[level] >= 0]
        np.minimum.at(first, link[level], first[level])
        np.maximum.at(last, link[level], last[level])
    alone = first == last
    climb = at.copy()
    while (up := alone[climb] & (climb > 0)).any():
        climb[up] = link[climb[up]]
    return np.split(length[climb], np.cumsum(sizes)[:-1])


def compare(length: int) -> Callable[[list[bytes], np.ndarray], list[np.ndarray]]:
    def masks(bodies: list[bytes], place: np.ndarray) -> list[np.ndarray]:
        found = matching_statistics([b.split() for b in bodies], place)
        return [own[length - 1 :] >= length for own in found]

    return masks


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th and spans (first word << 32 | end) of every repeated passage."""
    return repeated_spans(docs, unit(length), compare(length), SHARD_BYTES, keep_first=False)


def _kept(words: list[bytes], gone: np.ndarray | None) -> list[bytes]:
    return words if gone is None else [w for w, x in zip(words, gone.tolist()) if not x]


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the marked words and the white space after them."""
    _, start, _, _, _ = words_of([text])
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    starts = np.append(start, len(text))
    out, at = [], 0
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        out.append(text[at : starts[a]])
        at = starts[b]
    return b"".join([*out, text[at:]])


def remove_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, with all of their columns, without repeated passages; other texts stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(names.index("text")).to_pylist(), batch.column(len(names))
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                raw = texts[i].encode()
                texts[i] = cut(raw, covered(np.array([len(raw.split())]), spans.slice(i, 1))).decode()
            yield with_text(batch, names, texts)

    return with_spans(docs, repeated_passages(docs, length)).mapInArrow(run, docs.schema)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Counts of words and removed words, and a digest of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], SLICE_BYTES):
                words = [(t or "").encode().split() for t in texts[a:b]]
                sizes = np.fromiter(map(len, words), np.int64, b - a)
                masks = np.split(covered(sizes, batch.column(2).slice(a, b - a)), np.cumsum(sizes)[:-1])
                gone = [int(m.sum()) for m in masks]
                shas = [hashlib.sha256(b" ".join(_kept(w, m if n else None))).hexdigest() for w, m, n in zip(words, masks, gone)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b], pa.int64()), pa.array(sizes), pa.array(gone, pa.int64()), pa.array(shas, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    docs = docs.select("doc_id", "text")
    return with_spans(docs, repeated_passages(docs, length)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
