"""Byte-level BPE with word ends: encoding and decoding.

Encoding runs in batched merge rounds. The symbols of all words of a batch that
were not met before lie in one flat array; each round looks up every adjacent
pair by binary search over the sorted pair keys, finds the lowest rank of each
word, and merges all places of that pair at once. Words are encoded once per
task while a bounded memory of them lasts. A word of more than ``LONG`` bytes
would need thousands of rounds over all of its symbols; its pairs wait in a heap
by rank and place instead, which merges in the same order.

The vocabulary file is a parameter; it is shipped with SparkContext.addFile and
never copied into the repository. Its size (a few MB) is fixed by the
vocabulary and checked before it is sent.

Defined cases: a null text encodes as an empty one; strings of special tokens
in a text become those tokens; pairs of equal rank (the same pair) merge from
the left; repeated rows and ties of doc_id are encoded each; very long texts and
words are encoded whole; an empty table gives an empty result; columns other
than the two read are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

MAX_VOCABULARY_BYTES = 64 << 20
#: Words that a task remembers; beyond it the memory starts afresh.
MEMORY = 200_000
SLICE_CHARS = 4 << 20
#: Longest word that merges in rounds with others.
LONG = 1024
RESULT = "doc_id long, n_tokens long, ids binary, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_rank = made
        #: Pair -> rank and symbol made, filled when a long word comes.
        self.ranks: dict[int, tuple[int, int]] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = vocab | self.special
        self.names: list[str] = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.memory: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.memory.clear()
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then lower case letter by letter (no rule for a final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merge_long(self, raw: bytes) -> np.ndarray:
        """Ids of one word: the pair of lowest rank, from the left, merges until none is left."""
        if not self.ranks:
            self.ranks.update(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        flat = np.frombuffer(raw, np.uint8)
        symbols: list[int] = self.inner[flat].tolist()
        symbols[-1] = int(self.final[flat[-1]])
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        heap = [(found[0], i) for i in range(n - 1) if (found := get(symbols[i] << 32 | symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = get(symbols[i] << 32 | symbols[j])
            if found is None or found[0] != rank:
                continue
            symbols[i], symbols[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := get(symbols[i] << 32 | symbols[k]):
                    heapq.heappush(heap, (found[0], i))
            h = before[i]
            if h >= 0 and (found := get(symbols[h] << 32 | symbols[i])):
                heapq.heappush(heap, (found[0], h))
        return np.array([s for s in symbols if s >= 0], np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat, and where each word begins."""
        raw = [w.encode() for w in words]
        done_symbols, done_words = [], []
        for i, own in enumerate(raw):
            if len(own) > LONG:
                done_symbols.append(self.merge_long(own))
                done_words.append(np.full(len(done_symbols[-1]), i))
                raw[i] = b""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols = self.inner[flat]
        symbols[ends] = self.final[flat[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        while len(symbols):
            same = np.flatnonzero(word[:-1] == word[1:])
            key = symbols[same] << 32 | symbols[same + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            rank = np.full(len(symbols), _NONE)
            rank[same[hit]] = self.rank[found[hit]]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(word)))
            of_symbol = np.repeat(least, counts)
            over = of_symbol == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                keep = ~over
                symbols, word, rank, of_symbol = symbols[keep], word[keep], rank[keep], of_symbol[keep]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == of_symbol)
            if len(at) > 1 and (np.diff(at) == 1).any():  # a run like "aaa": pairs from the left, not overlapping
                run = np.cumsum(np.concatenate(([True], np.diff(at) != 1)))
                begin = np.searchsorted(run, run)
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbols[at] = self.by_rank[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        words_of = np.concatenate(done_words)
        order = np.argsort(words_of, kind="stable")
        start = np.searchsorted(words_of[order], np.arange(len(words) + 1))
        return np.concatenate(done_symbols)[order].astype(np.int32), start

    def _learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in dict.fromkeys(pieces) if p not in self.memory]
        if new:
            ids, start = self.merge(new)
            base = len(self.memory)
            self.memory.update(zip(new, range(base, base + len(new))))
            self.start = np.concatenate((self.start, start[1:] + self.start[-1]))
            self.ids = np.concatenate((self.ids, ids))

    def _plain(self, text: str) -> list[str]:
        return self.pieces.findall(self.normalise(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.memory) > MEMORY:
            self._reset()
        parts: list[list[str | int]] = []
        for text in texts:
            if self.split_special and "<" in text and len(cut := self.split_special.split(text)) > 1:
                own: list[str | int] = []
                for x in cut:
                    own += [self.special[x]] if x in self.special else self._plain(x)
                parts.append(own)
            else:
                parts.append(self._plain(text))
        self._learn(p for own in parts for p in own if isinstance(p, str))
        lookup = self.memory.__getitem__
        out = []
        for own in parts:
            if own and self.special and any(isinstance(p, int) for p in own):
                pieces = [np.array([p], np.int32) if isinstance(p, int) else self.ids[self.start[lookup(p)] : self.start[lookup(p) + 1]] for p in own]
                out.append(np.concatenate(pieces))
                continue
            which = np.fromiter(map(lookup, own), np.int64, len(own))
            begin = self.start[which]
            size = self.start[which + 1] - begin
            total = int(size.sum())
            step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            out.append(self.ids[np.repeat(begin, size) + step])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by blanks, as for a vocabulary without a decoder; unknown ids are left out."""
        names, top = self.names, len(self.names)
        return " ".join([names[i] for i in ids.tolist() if i < top and names[i]])


_CODECS: dict[str, Codec] = {}


def _codec(name: str) -> Codec:
    """This worker's codec, read from the file that Spark shipped."""
    if name not in _CODECS:
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _CODECS[name] = Codec(json.load(f))
    return _CODECS[name]


def _batches(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    from sparkatlas.llm.textcore import slices

    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in slices([len(t) for t in texts], SLICE_CHARS):
            yield keys[a:b], codec.encode(texts[a:b])


def _ship(docs: DataFrame, path: str) -> str:
    import os

    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32 bit) and the decoded text of every document."""
    name = _ship(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for keys, ids in _batches(codec, batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(map(codec.decode, ids), pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """As encode_documents, with SHA-256 digests in place of ids and decoded text, taken in the same pass."""
    name = _ship(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for keys, ids in _batches(codec, batches):
            hashes = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text decoded from the ids column of encode_documents; null ids decode as an empty text."""
    name = _ship(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            ids = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
