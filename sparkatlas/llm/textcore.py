"""Numpy kernels over the words or bytes of a batch of texts.

Everything here works on one bounded slice of an Arrow batch, flat across its
documents, so that the per-document Python cost stays small.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x9E6C63D0876A9A47)  # odd, so that it has an inverse mod 2**64
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit value for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, grown by doubling."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        with np.errstate(over="ignore"):
            up = np.full(size, _STEP)
            up[0] = 1
            down = np.full(size, np.uint64(pow(int(_STEP), -1, 1 << 64)))
            down[0] = 1
            _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[0]


class Spans:
    """Hashes of any span of a flat array of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        up, self._down = powers(len(symbols) + 1)
        self._sum = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(np.uint64) * _ODD)

    def every(self, width: int) -> np.ndarray:
        """Hash of each span of this width, by its start."""
        n = max(0, len(self._sum) - width)
        return mix((self._sum[width : width + n] - self._sum[:n]) * self._down[:n] + np.uint64(width * int(_ODD) % 2**64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words (runs without ASCII white space) of the texts.

    Returns the joined bytes, each word's start, end and 64-bit hash, and where
    each text's words begin (one entry more than texts).
    """
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[flat]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    return flat, start, end, Spans(flat.astype(np.uint64) + np.uint64(1))(start, end), np.searchsorted(start, bounds)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each run of width values, in two sweeps over blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    fill = np.uint64(2**64 - 1) if pick is np.minimum else np.uint64(0)
    padded = np.full(-(-len(values) // width) * width, fill)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(symbols: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Every window of length symbols dealt to one content-chosen trigger: its gram of least hash, the first of equals.

    Equal windows have equal triggers at equal places. The windows of a trigger
    follow one another; what they cover is its context. bounds: where each text
    begins, and the end. Returns each trigger's hash, its first window, how many
    windows it has, and the hash of its context and of its place there.
    """
    spans = Spans(symbols)
    grams = spans.every(gram)
    width = length - gram + 1
    if len(grams) < width:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding((grams & _HIGH) | place, width, np.minimum)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    window = np.flatnonzero(text[: len(least)] == text[length - 1 : length - 1 + len(least)])
    at = (least[window] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    lo, count = window[first], np.diff(np.append(first, len(at)))
    at = at[first]
    context = mix(spans(lo, lo + count - 1 + length) ^ ((at - lo).astype(np.uint64) * _ODD))
    return grams[at], lo, count, context


def slices(sizes: list[int], most: int):
    """Index ranges of at most this total size (or one item)."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)
