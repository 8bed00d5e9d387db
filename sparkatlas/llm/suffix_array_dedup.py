"""Suffix-array dedup by prefix-free parsing.

Bytes covered by a ``length``-byte string that starts earlier (smaller doc_id,
or earlier in the same document) go. ``repeats`` finds where strings may recur
and sends each distinct context once to a shard of bounded size. A shard's
texts are highly repetitive, so they are parsed: a rolling hash of ``GRAM``
bytes triggers the end of a phrase, wherever the text comes from. The distinct
phrases are the dictionary, the text is a sequence of phrases. The suffix array
of the dictionary and that of the parse (its phrases numbered in the order of
the dictionary) combine into the order of all places of the shard: by the rank
of the phrase suffix a place begins, then by that of the parse after it. Strings
are equal where neighbours have the length in common; the first place of each
string stays. Orders are kept as far as a string reaches.

Defined cases: null and empty texts have no bytes; repeated rows (same id and
text) share one verdict and do not count as earlier than each other; of equal
doc_ids with other texts the one of lesser text hash (xxhash64) comes first; a
null doc_id comes before all others; documents shorter than the length lose
nothing; very long texts are handled whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkatlas.llm import textcore
from sparkatlas.llm.repeats import SLICE_BYTES, Unit, covered, repeated_spans, with_spans
from sparkatlas.llm.textcore import slices

LENGTH = 100
GRAM = 8
#: One gram in so many ends a phrase.
SPACING = 16
SHARD_BYTES = 1_000_000


def unit(length: int = LENGTH) -> Unit:
    return Unit("bytes", length, max(1, length // 5), common=4096)


def suffix_ranks(values: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of many sequences, told apart on their first ``depth`` values.

    values: all sequences one after the other, from 1; stop: where the sequence
    of each place ends. Equal ranks, equal prefixes; a sequence that ends sorts
    before one that goes on. Ranks of prefixes are combined two by two, each
    round of twice the length (the last of as much as the depth leaves).
    """
    n = len(values)
    rank, size = values.astype(np.int64), 1
    place = np.arange(n)
    if n and (top := int(values.max())) < 256 and depth >= 7:  # the first seven bytes at once
        padded = np.append(rank, np.zeros(7, np.int64))
        rank = padded[:n].copy()
        for k in range(1, 7):
            rank = rank * (top + 1) + np.where(place + k < stop, padded[k : k + n], 0)
        rank, size = np.unique(rank, return_inverse=True)[1] + 1, 7
    longest = min(int((stop - place).max(initial=0)), depth)
    while size < longest:
        step = min(size, longest - size)
        after = place + step
        inside = after < stop
        second = np.where(inside, rank[np.minimum(after, n - 1)], 0)
        rank = np.unique(rank * (int(rank.max()) + 1) + second, return_inverse=True)[1] + 1
        size += step
    return rank


class Parse:
    """Prefix-free parse of texts, and the suffix arrays of its dictionary and of the sequence of its phrases.

    A phrase ends after ``gram`` bytes whose rolling hash triggers, whatever
    comes before, and the next one begins with those bytes; the last phrase of
    a text ends with it. No suffix of a phrase that holds its trigger is the
    beginning of another such suffix.
    """

    def __init__(self, texts: list[bytes], depth: int, gram: int = GRAM, spacing: int = SPACING):
        raw = b"".join(texts)
        flat = np.frombuffer(raw, np.uint8)
        self.gram = gram
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        hashes = textcore.Spans(textcore.BYTES[flat]).every(gram)
        ends = np.flatnonzero(hashes % np.uint64(spacing) == 0) + gram
        text = np.searchsorted(self.bounds, ends - gram, "right") - 1
        fits = (ends < self.bounds[text + 1]) & (ends - gram > self.bounds[text])
        #: Where each phrase begins and ends, and its text.
        inner, of = ends[fits], text[fits]
        self.begin = np.sort(np.concatenate((self.bounds[:-1], inner - gram)))
        self.text = np.searchsorted(self.bounds, self.begin, "right") - 1
        later = np.append(self.text[1:] == self.text[:-1], False)
        self.end = np.where(later, np.append(self.begin[1:], 0) + gram, self.bounds[self.text + 1])
        # dictionary: every distinct phrase once, and the order of its suffixes
        number: dict[bytes, int] = {}
        known = number.setdefault
        self.phrase = np.fromiter((known(raw[a:b], len(number)) for a, b in zip(self.begin.tolist(), self.end.tolist())), np.int64, len(self.begin))
        sizes = np.fromiter(map(len, number), np.int64, len(number))
        self.at = np.cumsum(sizes) - sizes
        dictionary = np.frombuffer(b"".join(number), np.uint8)
        letter = np.zeros(256, np.int64)
        used = np.unique(dictionary)
        letter[used] = np.arange(1, len(used) + 1)
        self.rank = suffix_ranks(letter[dictionary], np.repeat(self.at + sizes, sizes), depth)
        # order of the parse: its suffixes, as sequences of phrases in the order of the dictionary
        stop = np.searchsorted(self.begin, self.bounds[self.text + 1])
        self.order_of = suffix_ranks(self.rank[self.at[self.phrase]], stop, depth)

    def of(self, starts: np.ndarray) -> np.ndarray:
        """The phrase whose suffix (with all of its trigger) each place begins."""
        return np.searchsorted(self.begin, starts, "right") - 1


def equal_strings(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, class) of every string of this length in the texts (none empty): equal class, equal string.

    Places in corpus order are places by the rank of their phrase suffix, then
    by that of the parse after it; strings are equal where neighbours in that
    order have the length in common.
    """
    parse = Parse(texts, length, min(GRAM, length))
    sizes = np.diff(parse.bounds)
    counts = np.maximum(sizes - length + 1, 0)
    starts = np.repeat(parse.bounds[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    if not len(starts):
        return starts, starts
    at = parse.of(starts)
    head = parse.rank[parse.at[parse.phrase[at]] + starts - parse.begin[at]]
    # bytes of the string that lie beyond its phrase, and the parse suffix that holds them
    left = np.maximum(starts + length - parse.end[at], 0)
    flat = np.frombuffer(b"".join(texts) + bytes(length), np.uint8)
    order = np.argsort(parse.order_of, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows = np.lib.stride_tricks.sliding_window_view(flat, length)[parse.begin]
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    room = (parse.bounds[parse.text + 1] - parse.begin)[order]
    common = np.minimum(common, np.minimum(room[1:], room[:-1]))
    tail = np.zeros(len(starts), np.int64)
    by_left = np.argsort(left.astype(np.uint8 if length < 256 else np.int64), kind="stable")
    cuts = np.searchsorted(left[by_left], np.arange(1, length + 1))
    for size, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
        if b > a:
            own = by_left[a:b]
            begin = np.concatenate(([0], np.where(common < size + parse.gram, np.arange(1, len(order)), 0)))
            tail[own] = np.maximum.accumulate(begin)[place[at[own] + 1]] + 1
    return starts, np.unique(head * (len(order) + 1) + tail, return_inverse=True)[1]


def compare(length: int) -> Callable[[list[bytes], np.ndarray], list[np.ndarray]]:
    def masks(bodies: list[bytes], place: np.ndarray) -> list[np.ndarray]:
        starts, kind = equal_strings(bodies, length)
        bounds = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
        body = np.searchsorted(bounds, starts, "right") - 1
        here = place[body] + (starts - bounds[body])
        first = np.full(kind.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, kind, here)
        sizes = np.maximum(np.diff(bounds) - length + 1, 0)
        return np.split(first[kind] < here, np.cumsum(sizes)[:-1])

    return masks


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th and spans (first byte << 32 | end) of every string that starts earlier."""
    return repeated_spans(docs, unit(length), compare(length), SHARD_BYTES, keep_first=True, passes=3)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None], list]]:
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices([len(t or "") for t in texts], SLICE_BYTES):
            raw = [None if t is None else t.encode() for t in texts[a:b]]
            sizes = np.fromiter((len(t or b"") for t in raw), np.int64, b - a)
            spans = batch.column(2).slice(a, b - a)
            masks = np.split(covered(sizes, spans), np.cumsum(sizes)[:-1])
            yield keys[a:b], raw, [m if ok else None for m, ok in zip(masks, spans.is_valid().to_pylist())]


def _kept(text: bytes, gone: np.ndarray | None) -> bytes:
    return text if gone is None else np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and the remaining bytes of each text (cuts may fall inside a character, hence binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, masks in _apply(batches):
            out = [None if t is None else _kept(t, m) for t, m in zip(texts, masks)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "kept"])

    docs = docs.select("doc_id", "text")
    return with_spans(docs, repeated_strings(docs, length)).mapInArrow(run, "doc_id long, kept binary")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Counts of bytes, removed bytes and removed runs, and a digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, masks in _apply(batches):
            texts = [t or b"" for t in texts]
            gone = [0 if m is None else int(m.sum()) for m in masks]
            runs = [0 if m is None else int(m[0]) + int((m[1:] & ~m[:-1]).sum()) for m in masks]
            shas = [hashlib.sha256(_kept(t, m)).hexdigest() for t, m in zip(texts, masks)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    docs = docs.select("doc_id", "text")
    return with_spans(docs, repeated_strings(docs, length)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
