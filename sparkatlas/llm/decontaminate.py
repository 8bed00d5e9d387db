"""Benchmark decontamination by a generalised suffix automaton.

Normalised test items go into one automaton over words. Every word of a
training text is streamed through it; the longest match that ends at the word
tells whether a whole window of an item ends there. Windows are ``window``
consecutive words of an item, or the whole item where it is shorter.

Words that no item has reset the automaton, so only runs of known words are
streamed, and of those only runs with enough consecutive item trigrams (found
in a bitmap) to hold a window; the automaton alone decides what is hit.

The automaton is broadcast. Items are taken in blocks of at most
``block_words`` words (or one item), one automaton each. Where there is more
than one block, the documents pass the blocks one after another: what a block
hits is written before the next automaton is built and the last one dropped, so
that no process ever holds more than one, however many items there are; the
hits of a document are merged at the end.

Defined cases: null or word-less texts and items have no words and match
nothing; ties and repeated items are separate items; repeated rows are separate
documents; very long texts are streamed whole; empty tables give no hits; extra
columns are ignored by ``find_hits`` and kept by ``decontaminate``, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm.automaton import SuffixAutomaton
from sparkatlas.llm.common import stored, unused, with_text
from sparkatlas.llm.textcore import mix, slices

WINDOW = 10
BLOCK_WORDS = 200_000
SLICE_BYTES = 4 << 20
_BITS = 22
#: Lower-cases A-Z; every other byte below 0x80 that is no letter or digit parts words.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HITS = "doc_id long, text string, n_words long, starts array<int>, ends array<int>, items array<long>"


def clean_words(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


class Automaton(SuffixAutomaton):
    """Suffix automaton of many word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        sequences = [(i, [number(w, len(self.vocabulary)) for w in clean_words(t)]) for i, t in items]
        sequences = [(i, s) for i, s in sequences if s]
        super().__init__()
        for _, seq in sequences:
            self.insert(seq)
        self.shortest = min((min(window, len(s)) for _, s in sequences), default=0)
        self._windows(sequences)
        self._bitmap([s for _, s in sequences])

    def _windows(self, sequences: list[tuple[int, list[int]]]) -> None:
        """Per state the items whose window of full size ends there, and per state the short whole items."""
        self.full: dict[int, list[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for item, seq in sequences:
            size = min(self.window, len(seq))
            for i, (state, matched) in enumerate(self.stream(seq)):
                if i + 1 >= size:
                    assert matched >= size
                    at = self.suffix(state, size)
                    if size == self.window:
                        own = self.full.setdefault(at, [])
                        if not own or own[-1] != item:
                            own.append(item)
                    elif i + 1 == size:
                        short.setdefault(at, []).append((size, item))
        # a short item also ends wherever a longer match ends in it
        self.short: dict[int, list[tuple[int, int]]] = {}
        if short:
            for state in sorted(range(len(self.next)), key=self.length.__getitem__):
                found = short.get(state, []) + self.short.get(self.link[state], []) if state else []
                if found:
                    self.short[state] = found

    def _bitmap(self, sequences: list[list[int]]) -> None:
        """Bits of the trigrams of items (none needed where an item has fewer than three words)."""
        self.run = max(self.shortest - 2, 0)
        self.bits = np.zeros(1 << _BITS, bool)
        for seq in sequences:
            ids = np.array(seq, np.int64)
            if len(ids) >= 3:
                self.bits[self._slot(ids)] = True

    @staticmethod
    def _slot(ids: np.ndarray) -> np.ndarray:
        x = ids.astype(np.uint64)
        return (mix((x[:-2] << np.uint64(42)) ^ (x[1:-1] << np.uint64(21)) ^ x[2:]) >> np.uint64(64 - _BITS)).astype(np.int64)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words that could hold a window."""
        if self.shortest == 0 or len(ids) < self.shortest:
            return []
        if self.run:
            good = self.bits[self._slot(ids)] & (ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0)
            least, more = self.run, 2
        else:
            good, least, more = ids >= 0, 1, 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        return [(a, b + more) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()) if b - a >= least]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal spans of hit words, and the items whose windows occur."""
        if not self.vocabulary:
            return [], set()
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in self.candidates(ids):
            for i, (state, matched) in enumerate(self.stream(ids[a:b].tolist()), a + 1):
                size = 0
                if matched >= self.window:
                    own = self.full.get(self.suffix(state, self.window))
                    if own:
                        size = self.window
                        items.update(own)
                if self.short and matched:
                    for n, item in self._short_at(state, matched):
                        size = max(size, n)
                        items.add(item)
                if size:
                    if spans and i - size <= spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], i - size), i)
                    else:
                        spans.append((i - size, i))
        return spans, items

    def _short_at(self, state: int, matched: int) -> list[tuple[int, int]]:
        return [(n, item) for n, item in self.short.get(state, []) if n <= matched]


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, bytes]]]:
    """(item_id, text) in blocks of bounded size, read partition by partition."""
    block: list[tuple[int, bytes]] = []
    total = 0
    for row in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        raw = row.text.encode()
        n = len(clean_words(raw))
        if total and total + n > block_words:
            yield block
            block, total = [], 0
        if n:
            block.append((row.item_id, raw))
            total += n
    yield block


Found = tuple[int, list[tuple[int, int]], list[int]]


def _scan(text: bytes, automaton: Automaton) -> Found:
    """Words, spans of hit words and items found of one text."""
    words = clean_words(text)
    spans, items = automaton.match(words)
    return len(words), merged(spans), sorted(items - {None})


def scanned(docs: DataFrame, items: DataFrame, window: int, block_words: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[Found]]]:
    """docs, with columns added at the end if they passed several blocks, and what finds the hits of a batch of them."""
    at, width = docs.columns.index("text"), len(docs.columns)
    sc = docs.sparkSession.sparkContext
    blocks = item_blocks(items, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        automaton = sc.broadcast(Automaton(first, window))
        return docs, lambda batch: [_scan((t or "").encode(), automaton.value) for t in batch.column(at).to_pylist()]
    found: DataFrame | None = None
    for block in chain([first, second], blocks):
        automaton = sc.broadcast(Automaton(block, window))

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [_scan((t or "").encode(), automaton.value) for t in batch.column(1).to_pylist()]
                hit = [i for i, r in enumerate(rows) if r[1]]
                spans = pa.array([[a << 32 | b for a, b in rows[i][1]] for i in hit], pa.list_(pa.int64()))
                ids = pa.array([rows[i][2] for i in hit], pa.list_(pa.int64()))
                pick = pa.array(hit, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(2).take(pick), spans, ids], names=["doc_id", "th", "spans", "items"])

        slim = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
        own = stored(slim.mapInArrow(run, "doc_id long, th long, spans array<long>, items array<long>"), "hits")
        automaton.destroy()
        found = own if found is None else found.unionByName(own)
    merge = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    found = found.groupBy("doc_id", "th").agg(merge("spans"), merge("items"))
    i, t, s, m = (unused(docs, name) for name in ("hits_doc_id", "hits_th", "hits_spans", "hits_items"))
    found = found.toDF(i, t, s, m).hint("shuffle_merge")
    both = docs.join(found, docs["doc_id"].eqNullSafe(found[i]) & (F.xxhash64(docs["text"]) == found[t]), "left").drop(i, t)

    def read(batch: pa.RecordBatch) -> list[Found]:
        texts, spans, ids = (batch.column(k).to_pylist() for k in (at, width, width + 1))
        return [(len(clean_words((x or "").encode())), merged([(v >> 32, v & 0xFFFFFFFF) for v in own or []]), sorted(y or [])) for x, own, y in zip(texts, spans, ids)]

    return both, read


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = True) -> DataFrame:
    """Per document its text (null unless keep_text), words, spans of hit words (starts, ends) and ids of the items found.

    An item whose id is null hits words but is not listed.
    """
    frame, found = scanned(docs.select("doc_id", "text"), items, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in slices(sizes, SLICE_BYTES):
                own = batch.slice(a, b - a)
                rows = found(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0).cast(pa.int64()),
                        own.column(1) if keep_text else pa.nulls(b - a, pa.string()),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([[s for s, _ in r[1]] for r in rows], pa.list_(pa.int32())),
                        pa.array([[e for _, e in r[1]] for r in rows], pa.list_(pa.int32())),
                        pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text", "n_words", "starts", "ends", "items"],
                )

    return frame.mapInArrow(run, HITS)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the start and end of each word."""
    inside = np.frombuffer(text.translate(_CLEAN), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the hit spans, from a span's first word to its last."""
    if not spans:
        return text
    start, end = word_places(text)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : start[a]])
        at = end[b - 1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, with all of their columns, without benchmark text.

    Spans of hit words are cut out; a document of which they cover more than
    ``max_coverage`` goes. Texts without hits stay as they are.
    """
    frame, found = scanned(docs, items, window, block_words)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keep = [], []
            for text, (n_words, spans, _) in zip(batch.column(at).to_pylist(), found(batch)):
                keep.append(sum(b - a for a, b in spans) <= max_coverage * n_words)
                out.append(cut(text.encode(), spans).decode() if spans else text)
            yield with_text(batch, names, out, keep)

    return frame.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts of hit words and a digest of the items found, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, items_of = (batch.column(i).to_pylist() for i in (2, 3, 4))
            hit = [sum(e) - sum(s) for s, e in zip(starts, ends)]
            shas = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items_of]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(map(len, items_of), pa.int64()), pa.array(shas, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    slim = find_hits(docs, items, window, keep_text=False).select("doc_id", "n_words", "starts", "ends", "items")
    return slim.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
