"""Quality classifier: a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad from features of its own and of
the lines before and after it; the chain couples neighbouring labels. A
document's quality is the mean of its lines' marginals of being good, weighted
by length, and a logistic curve fitted on the training documents turns it into
a score.

The model is fitted on the driver, on features (never texts) of at most
``max_docs`` labelled documents per class, taken by a hash of their id, one row
an id, and of these, in that order, as many as have ``max_lines`` lines in all;
each line bears its document's label. These bounds are the only sample; every
document is scored, whole.

Defined cases: a null, empty or blank text has no lines and no good part, and
gets the score of such; of repeated labels of a document the largest holds; of
rows that repeat a doc_id all are scored, and training takes the one whose text
has the least hash;
labels of unknown documents and null labels are left out; with labels of one
class only, or none, every score is that share (one half without any); very
long texts are handled whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm import textcore
from sparkatlas.llm.common import discard, stored
from sparkatlas.llm.textcore import slices

MAX_DOCS = 1500
#: Most lines that the fit sees (64 bytes each).
MAX_LINES = 400_000
SLICE_BYTES = 2 << 20
ROUNDS = 150


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


#: Kinds of bytes whose share of a line is a feature.
KINDS = [_table(b"#*$%&<>"), _table(b"|"), _table(b"!"), _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58))), _table(b".,;:?'\"()-"), _table(b"@/\\=_{}[]~^+"), _table(bytes(range(128, 256)))]
N_OWN = len(KINDS) + 6


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that has a word, the lines' byte lengths, and where each text's lines begin."""
    flat, start, end, values, word_bounds = textcore.words(texts)
    ends = np.flatnonzero(flat == 10)  # the join adds one after each text
    begins = np.concatenate(([0], ends[:-1] + 1))
    first = np.searchsorted(start, begins)
    n_words = np.searchsorted(start, ends) - first
    keep = n_words > 0
    begins, ends, first, n_words = begins[keep], ends[keep], first[keep], n_words[keep]
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    line_bounds = np.searchsorted(begins, np.concatenate(([0], text_ends)))
    size = (ends - begins).astype(np.float32)
    own = np.zeros((len(begins), N_OWN), np.float32)
    if not len(begins):
        return own, size, line_bounds
    for k, table in enumerate(KINDS):
        total = np.concatenate(([0.0], np.cumsum(table[flat], dtype=np.float64)))
        own[:, k] = (total[ends] - total[begins]) / size
    line = np.repeat(np.arange(len(begins)), n_words)
    k = len(KINDS)
    own[:, k] = np.log1p(size)
    own[:, k + 1] = np.log1p(n_words)
    own[:, k + 2] = np.add.reduceat((end - start).astype(np.float32), first) / n_words
    again = np.zeros(len(values), np.float32)
    again[1:] = (values[1:] == values[:-1]) & (line[1:] == line[:-1])
    own[:, k + 3] = np.add.reduceat(again, first) / n_words
    told_apart = np.unique(textcore.mix(values ^ textcore.mix(line.astype(np.uint64))), return_index=True)[1]
    own[:, k + 4] = np.bincount(line[told_apart], minlength=len(begins)) / n_words
    text = np.searchsorted(line_bounds, np.arange(len(begins)), "right") - 1
    whole = textcore.mix(textcore.Spans(flat.astype(np.uint64) + np.uint64(1))(begins, ends) ^ textcore.mix(text.astype(np.uint64)))
    seen = np.ones(len(begins), np.float32)
    seen[np.unique(whole, return_index=True)[1]] = 0
    own[:, k + 5] = seen
    return own, size, line_bounds


def with_neighbours(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text (zeros at its ends), and a constant."""
    n = len(own)
    first = np.zeros(n + 1, bool)
    first[bounds[:-1]] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:n]] = 0
    after[np.append(first[1:n], True)[:n]] = 0
    return np.hstack((own, before, after, np.ones((n, 1), np.float32)))


class Chains:
    """Lines of many texts laid out step by step: the first lines of all texts, then the second lines."""

    def __init__(self, bounds: np.ndarray):
        self.sizes = np.diff(bounds)
        by_size = np.argsort(-self.sizes, kind="stable")
        by_size = by_size[self.sizes[by_size] > 0]
        self.steps = int(self.sizes.max(initial=0))
        self.active = len(by_size) - np.searchsorted(np.sort(self.sizes[by_size]), np.arange(self.steps), "right")
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        self.line = np.concatenate([bounds[:-1][by_size[:a]] + t for t, a in enumerate(self.active)] or [np.zeros(0, np.int64)])
        self.chain = np.concatenate([by_size[:a] for a in self.active] or [np.zeros(0, np.int64)])

    def marginals(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line (in line order) and expected transitions, each chain weighing one over its length.

        emit: score of good over bad per line; trans[i, j]: score of j after i.
        """
        x = np.zeros((len(self.line), 2))
        x[:, 1] = emit[self.line]
        alpha, beta = x.copy(), np.zeros_like(x)
        o, a = self.offset, self.active
        for t in range(1, self.steps):
            prev, here = alpha[o[t - 1] : o[t - 1] + a[t]], slice(o[t], o[t + 1])
            alpha[here] += np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
        for t in range(self.steps - 2, -1, -1):
            nxt = beta[o[t + 1] : o[t + 2]] + x[o[t + 1] : o[t + 2]]
            beta[o[t] : o[t] + a[t + 1]] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
        joint = alpha + beta
        total = np.logaddexp(joint[:, 0], joint[:, 1])
        good = np.empty(len(self.line))
        good[self.line] = np.exp(joint[:, 1] - total)
        pairs = np.zeros((2, 2))
        weight = 1 / self.sizes[self.chain] if len(self.chain) else np.zeros(0)
        for t in range(1, self.steps):
            prev, here = slice(o[t - 1], o[t - 1] + a[t]), slice(o[t], o[t + 1])
            nxt = beta[here] + x[here]
            both = np.exp(alpha[prev][:, :, None] + trans + nxt[:, None, :] - total[here][:, None, None])
            pairs += (both * weight[here][:, None, None]).sum(axis=0)
        return good, pairs


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def good_lines(self, own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x = with_neighbours((own - self.mean) / self.scale, bounds)
        return Chains(bounds).marginals(x @ self.weights, self.trans)[0]

    def good_parts(self, own: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Share of each text, by length, that is good."""
        sums = lambda v: np.diff(np.concatenate(([0.0], np.cumsum(v)))[bounds])
        return sums(self.good_lines(own, bounds) * size) / np.maximum(sums(size), 1)

    def score(self, part: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * (part - 0.5) + self.shift)))


def fit(own: np.ndarray, size: np.ndarray, bounds: np.ndarray, labels: np.ndarray, share_good: float, rounds: int = ROUNDS) -> Model:
    """Fit by gradient ascent (Adam) on the chains' conditional likelihood, then the curve from good part to score."""
    mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-3
    x = with_neighbours((own - mean) / scale, bounds)
    chains = Chains(bounds)
    y = np.repeat(labels, np.diff(bounds)).astype(float)
    weight = np.repeat(1 / np.maximum(np.diff(bounds), 1), np.diff(bounds))
    n = len(labels)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        own_sizes = np.diff(bounds)[labels == k]
        seen[k, k] = np.maximum(own_sizes - 1, 0).dot(1 / np.maximum(own_sizes, 1))
    theta = np.zeros(x.shape[1] + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs = chains.marginals(x @ w, trans)
        g = np.concatenate((x.T @ ((y - good) * weight), (seen - pairs).ravel())) / n - 1e-3 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta += 0.08 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    part = model.good_parts(own, size, bounds) - 0.5
    # the sample takes as many of each class; the curve is fitted at their true shares
    share = np.where(labels == 1, share_good / max((labels == 1).sum(), 1), (1 - share_good) / max((labels == 0).sum(), 1))
    ab = np.array([1.0, 0.0])
    design = np.stack((part, np.ones(n)), 1)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-design @ ab))
        grad = design.T @ ((labels - p) * share) - 1e-3 * ab * (1, 0)
        hess = (design * (p * (1 - p) * share)[:, None]).T @ design + np.diag((1e-3, 1e-6))
        ab = ab + np.linalg.solve(hess, grad)
    model.slope, model.shift = float(ab[0]), float(ab[1])
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_features(docs: DataFrame, labels: DataFrame, max_docs: int, max_lines: int = MAX_LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Line features of the sampled training documents, and the share of good ones among all training labels."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(~held_out())
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for q in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most two times max_docs rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in raw], SLICE_BYTES):
                own, size, bounds = line_features(raw[a:b])
                blobs = [own[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
                sizes = [size[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
                keys = [batch.column(k).slice(a, b - a).cast(pa.int64()) for k in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.diff(bounds)), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], names=["doc_id", "quality", "th", "n_lines", "own", "size"])

    found = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(sample, "doc_id").select("doc_id", "text", "quality", "th")
    found = stored(found.mapInArrow(run, "doc_id long, quality long, th long, n_lines long, own binary, size binary"), "line-features")
    # sizes first: at most two times max_docs rows reach the driver, and only as many lines as allowed
    one = found.where("n_lines > 0").groupBy("doc_id").agg(F.min(F.struct("th", "n_lines", "quality")).alias("one")).select("doc_id", "one.*")
    chosen, lines = {}, 0
    for r in sorted(one.orderBy(F.xxhash64("doc_id"), "doc_id").collect(), key=lambda r: r.n_lines > max_lines // 4):
        if lines + r.n_lines <= max_lines:
            chosen[r.doc_id] = r.th
            lines += r.n_lines
    rows = {}
    for r in found.where(F.col("doc_id").isin(list(chosen))).dropDuplicates(["doc_id", "th"]).collect() if chosen else []:
        if r.th == chosen[r.doc_id]:
            rows[r.doc_id] = r
    discard(found)
    rows = [rows[k] for k in sorted(rows)]
    own = np.concatenate([np.frombuffer(r.own, np.float32).reshape(-1, N_OWN) for r in rows] or [np.zeros((0, N_OWN), np.float32)])
    size = np.concatenate([np.frombuffer(r.size, np.float32) for r in rows] or [np.zeros(0, np.float32)])
    bounds = np.concatenate(([0], np.cumsum([len(r.size) // 4 for r in rows]))).astype(np.int64)
    total = counts.get(0, 0) + counts.get(1, 0)
    return own, size, bounds, np.array([r.quality for r in rows], np.int64), counts.get(1, 0) / total if total else 0.5


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    own, size, bounds, y, share = training_features(docs, labels, max_docs)
    if len(set(y.tolist())) < 2:
        width = 3 * N_OWN + 1
        even = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return Model(np.zeros(N_OWN, np.float32), np.ones(N_OWN, np.float32), np.zeros(width), np.zeros((2, 2)), 0.0, even)
    return fit(own, size, bounds, y, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in raw], SLICE_BYTES):
                part = shared.value.good_parts(*line_features(raw[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.score(part))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
