"""Gated recurrent language model with a class-factored softmax, in numpy.

Word counts cover all training documents. A word is known by a 64-bit hash of
its bytes. The counts of the most frequent words (``HEAD`` of them, so that
they can be broadcast) travel to every task; all other counts are joined. The
``SOFT`` most frequent words are dealt to ``CLASSES`` classes, cut where the sums
of the square roots of their counts are even, so that classes of frequent words
are small. A token's probability is that of its class given the state, times
that of the word given class and state: every class has a softmax of its own
over all of its words. All other words share the last class; the state predicts
that class, and the word in it goes by its smoothed count.

Training runs over every training document, in ``ROUNDS`` rounds over parts of
them. A document's round and replica go by a hash of its id, and the number of
replicas by the number of training tokens, never by how the table is
partitioned; the outcome depends on partitions only by the rounding of sums.
Within a round each replica trains its own copy by truncated backpropagation
over windows of parallel streams, with the state carried through whole
documents; copies are averaged by tokens through rounds of partial sums, never
all on the driver. Scoring carries the state across windows through each whole
document; many documents advance side by side, and a stream that ends one
begins the next with a clean state.

Defined cases: null and empty texts have the end token only; without training
documents N, V and all counts are 0 and every token is unknown; repeated rows
and rows of equal doc_id are trained on and scored each; words of equal counts
are ranked by their hash; a null doc_id is not held out; very long texts are
scored whole, whatever their words' lengths; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm import textcore
from sparkatlas.llm.common import discard, release, stored
from sparkatlas.llm.textcore import slices

#: Most words whose counts are broadcast.
HEAD = 1 << 17
#: Most words that a class's softmax predicts.
SOFT = 1 << 15
CLASSES = 128
WIDTH = 16
#: Numbers of a word's input vector.
RANK = 16
ROUNDS = 3
RATE = 0.3
#: Training tokens of a replica, about.
REPLICA_TOKENS = 4_000_000
#: Tokens of a step, about, and the fewest steps in time of a window.
STEP_TOKENS = 32768
WINDOW = 16
#: Streams side by side: at least, and at most.
STREAMS = (128, 512)
#: Steps that training makes at least where there are tokens enough; smaller replicas have fewer streams and smaller steps.
LEAST_STEPS = 40
SLICE_BYTES = 1 << 20
#: Rows of the softmax over classes that are worked through at once, so that they stay in a core's cache; so many numbers in the others.
CACHED_ROWS = 1 << 10
#: Tokens that a task scores side by side.
SCORE_TOKENS = 4_000_000
#: Distinct words that a task counts before it passes them on.
MEMORY_WORDS = 1_000_000
#: The end of a document, as the hash of a word.
END = np.uint64(0x0E4D0F7E87A1C0DE)
#: Above this a softmax is taken off its largest input first.
SAFE = 60.0
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text's followed by END, and tokens per text."""
    _, _, _, values, bounds = textcore.words([t.translate(_LOWER) for t in texts])
    sizes = np.diff(bounds) + 1
    out = np.full(int(sizes.sum()), END)
    out[np.arange(len(values)) + np.repeat(np.arange(len(texts)), sizes - 1)] = values
    return out, sizes


class Vocabulary:
    """The head's words by falling count, their classes, and totals of all counts."""

    def __init__(self, words: np.ndarray, count: np.ndarray, total: int, distinct: int, soft: int = SOFT, classes: int = CLASSES):
        self.order = np.argsort(words)
        self.sorted = words[self.order]
        self.count, self.total, self.distinct = count.astype(np.float64), total, distinct
        n = len(words)
        self.soft = min(soft, n)
        own = self.count[: self.soft]
        step = np.cumsum(np.sqrt(own))
        classes = min(classes, max(self.soft, 1))
        kind = np.minimum((step / max(step[-1], 1.0) * classes).astype(np.int64), classes - 1) if self.soft else np.zeros(0, np.int64)
        kind = np.unique(kind, return_inverse=True)[1]
        #: First word of each class (its words follow one another), and the end.
        self.first = np.concatenate((np.searchsorted(kind, np.arange(kind.max(initial=-1) + 1)), [self.soft])).astype(np.int64)
        self.classes = len(self.first) - 1
        #: The class of each head word, and as the last entry that of all others.
        self.kind = np.concatenate((kind, np.full(n - self.soft + 1, self.classes))).astype(np.int16)
        #: Input numbers: one for each word of a softmax, one for all others, one for the start.
        self.input = np.append(np.minimum(np.arange(n), self.soft), self.soft).astype(np.int32)
        self.tail_mass = max(total - float(own.sum()) + 0.5 * (distinct - self.soft + 1), 0.5)
        #: ln P(word | last class) of head words without a softmax; 0 for those whose counts are joined later.
        self.within = np.zeros(n + 1)
        self.within[self.soft : n] = np.log((self.count[self.soft :] + 0.5) / self.tail_mass)

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words by rank; the number of head words for all others."""
        n = len(self.sorted)
        if not n:
            return np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.sorted, words), n - 1)
        return np.where(self.sorted[at] == words, self.order[at], n).astype(np.int32)


@dataclass
class Params:
    """All weights, in single precision."""

    e: np.ndarray  # input vectors
    q: np.ndarray  # those to gates: update, reset and new side by side, the bias last
    u: np.ndarray  # state to gates
    w: np.ndarray  # state to classes, the bias last
    y: np.ndarray  # state to the words of each class, the bias last

    @classmethod
    def fresh(cls, vocab: Vocabulary, seed: int = 7) -> Params:
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        w, y = np.zeros((vocab.classes + 1, WIDTH + 1), np.float32), np.zeros((vocab.soft, WIDTH + 1), np.float32)
        own = vocab.count[: vocab.soft] + 0.5
        mass = np.append(np.add.reduceat(own, vocab.first[:-1]) if vocab.soft else [], vocab.tail_mass)
        w[:, WIDTH] = np.log(mass / mass.sum())
        y[:, WIDTH] = np.log(own / mass[vocab.kind[: vocab.soft]])
        q = f(RANK + 1, 3 * WIDTH, scale=0.25)
        q[RANK] = 0
        return cls(f(vocab.soft + 2, RANK, scale=0.5), q, f(WIDTH, 3 * WIDTH, scale=0.25), w, y)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def like(self, flat: np.ndarray) -> Params:
        out, at = [], 0
        for f in fields(self):
            a = getattr(self, f.name)
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Params(*out)


def _softmax(x: np.ndarray, safe: bool) -> np.ndarray:
    """Exponentials of x in place; returns the sum of each row."""
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


class Network:
    """Forward and backward passes over windows of parallel streams (time first)."""

    def __init__(self, vocab: Vocabulary, params: Params):
        self.vocab, self.p = vocab, params
        self.bound()

    def bound(self) -> None:
        """Whether no input of a softmax can be far from zero (states lie within -1 and 1)."""
        far = lambda a: float((np.abs(a[:, :WIDTH]).sum(axis=1) + np.abs(a[:, WIDTH])).max(initial=0))
        self.safe_w, self.safe_y = far(self.p.w) < SAFE, far(self.p.y) < SAFE

    def states(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, learn: bool = True) -> tuple[np.ndarray, tuple]:
        """States after each step, and what backward needs; fresh marks where a document begins (clean state).

        Inside, a row holds one number of all streams, so that gates are whole blocks.
        """
        p, n = self.p, WIDTH
        out = np.empty((*inputs.shape, n), p.u.dtype)
        half = np.repeat([0.5, 0.5, 1.0], n).astype(p.u.dtype)[:, None]  # the logistic function by way of tanh
        u = p.u.T * half
        gates = (p.q[:RANK].T * half) @ p.e[inputs].transpose(0, 2, 1)
        gates += p.q[RANK][:, None] * half
        clean = fresh.any(axis=1)
        before, pulls = [], []
        h = h.T.copy()
        for t in range(len(inputs)):
            if clean[t]:
                h = h * ~fresh[t]
            a = u @ h
            zr, r, new = gates[t, : 2 * n], gates[t, n : 2 * n], gates[t, 2 * n :]
            zr += a[: 2 * n]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            new += r * a[2 * n :]
            np.tanh(new, out=new)
            if learn:
                before.append(h)
                pulls.append(a[2 * n :])
            h = h - new
            h *= zr[:n]
            h += new
            out[t] = h.T
        return out, (gates, before, pulls)

    def outputs(self, h: np.ndarray, words: np.ndarray, learn: bool) -> tuple[np.ndarray, dict]:
        """Natural log probability of each word (rows of h) without joined counts, and gradients of their sum."""
        p, v = self.p, self.vocab
        kind = v.kind[words]
        order = np.argsort(kind, kind="stable")
        h1 = np.ones((len(words), WIDTH + 1), h.dtype)
        h1[:, :WIDTH] = h[order]
        words, kind = words[order], kind[order]
        at = np.arange(len(words))
        logp = v.within[words]
        grads: dict = {}
        if learn:
            grads = {"w": np.zeros_like(p.w), "y": []}
            dh = np.empty((len(words), WIDTH), h.dtype)
        for a in range(0, len(words), CACHED_ROWS):
            b = min(a + CACHED_ROWS, len(words))
            hk = h1[a:b]
            x = hk @ p.w.T
            total = _softmax(x, self.safe_w)
            mine = (at[: b - a], kind[a:b])
            own = x[mine]
            logp[a:b] += np.log(own / total)
            if learn:
                x[mine] = own - total
                total = (-1 / total)[:, None]
                grads["w"] += x.T @ (hk * total)
                np.multiply(x @ p.w[:, :WIDTH], total, out=dh[a:b])
        cuts = np.searchsorted(kind, np.arange(v.classes + 1)).tolist()
        first = v.first.tolist()
        for k in range(v.classes):
            if cuts[k] == cuts[k + 1]:
                continue
            yk = p.y[first[k] : first[k + 1]]
            dy = 0
            rows = max(1, CACHED_ROWS * (v.classes + 1) // len(yk))
            for a in range(cuts[k], cuts[k + 1], rows):
                b = min(a + rows, cuts[k + 1])
                hk = h1[a:b]
                x = hk @ yk.T
                total = _softmax(x, self.safe_y)
                mine = (at[: b - a], words[a:b] - first[k])
                own = x[mine]
                logp[a:b] += np.log(own / total)
                if learn:
                    x[mine] = own - total
                    total = (-1 / total)[:, None]
                    dy = dy + x.T @ (hk * total)
                    dh[a:b] += (x @ yk[:, :WIDTH]) * total
            if learn:
                grads["y"].append((slice(first[k], first[k + 1]), dy))
        out = np.empty(len(words))
        out[order] = logp
        if learn:
            grads["h"] = np.empty_like(dh)
            grads["h"][order] = dh
        return out, grads

    def backward(self, inputs: np.ndarray, fresh: np.ndarray, trail: tuple, d_out: np.ndarray) -> dict:
        """Gradients through the window (truncated at its start)."""
        p, n = self.p, WIDTH
        gates, h0 = trail[0], np.stack(trail[1])
        z, r, new = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        # slopes of the gates' inputs, of all steps at once
        to_r = 1 - r
        to_r *= r
        to_r *= np.stack(trail[2])
        off = 1 - z
        to_z = h0 - new
        to_z *= z
        to_z *= off
        to_new = new * new
        np.subtract(1, to_new, out=to_new)
        to_new *= off
        g, dnew = np.empty_like(gates), off
        dh = np.zeros_like(h0[0])
        clean = fresh.any(axis=1)
        for t in range(len(inputs) - 1, -1, -1):
            dh += d_out[t].T
            np.multiply(dh, to_z[t], out=g[t, :n])
            np.multiply(dh, to_new[t], out=dnew[t])
            np.multiply(dnew[t], to_r[t], out=g[t, n : 2 * n])
            np.multiply(dnew[t], r[t], out=g[t, 2 * n :])
            dh *= z[t]
            dh += p.u @ g[t]
            if clean[t]:
                dh *= ~fresh[t]
        du = (h0 @ g.transpose(0, 2, 1)).sum(axis=0)
        g[:, 2 * n :] = dnew
        dq = np.empty_like(p.q)
        dq[:RANK] = (g @ p.e[inputs]).sum(axis=0).T
        dq[RANK] = g.sum(axis=2).sum(axis=0)
        de = g.transpose(0, 2, 1) @ p.q[:RANK].T
        rows, de = _summed(inputs.ravel(), de.reshape(-1, RANK))
        return {"u": du, "q": dq, "rows": rows, "e": de}


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    order = np.argsort(keys.astype(np.min_scalar_type(keys.max(initial=0))), kind="stable")  # two bytes are sorted by counting
    own = keys[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return own[first], np.add.reduceat(values[order], first, axis=0) if len(own) else values


class Dealt:
    """Documents laid over parallel streams, longest first, each to the shortest stream; the longest streams come first."""

    def __init__(self, vocab: Vocabulary, ids: np.ndarray, sizes: np.ndarray, least_steps: int = 1):
        least, most = STREAMS
        self.tokens = min(STEP_TOKENS, len(ids) // least_steps)
        most = min(most, self.tokens // WINDOW)
        n = int(max(1, min(most, len(sizes), max(least, len(ids) // max(int(sizes.max(initial=1)), 1)))))
        heap = [(0, s) for s in range(n)]
        stream = np.zeros(len(sizes), np.int64)
        for d in np.argsort(-sizes, kind="stable").tolist():
            load, s = heapq.heappop(heap)
            stream[d] = s
            heapq.heappush(heap, (load + int(sizes[d]), s))
        load = np.bincount(stream, sizes, n).astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[np.argsort(-load, kind="stable")] = np.arange(n)
        order = np.lexsort((np.arange(len(sizes)), rank[stream]))
        self.load = np.sort(load)[::-1]
        self.at = np.cumsum(self.load) - self.load
        first = np.cumsum(sizes) - sizes
        own = sizes[order]
        self.begin = np.cumsum(own) - own
        self.word = ids[np.repeat(first[order] - self.begin, own) + np.arange(len(ids))]
        self.doc = np.repeat(order, own).astype(np.int32)
        self.fresh = np.zeros(len(ids), bool)
        self.fresh[self.begin] = True
        self.input = np.append([vocab.soft + 1], vocab.input[self.word[:-1]]).astype(np.int32)
        self.input[self.begin] = vocab.soft + 1

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of the flat arrays, which of them belong to a document), by time and stream, until all streams end."""
        t, steps = 0, int(self.load.max(initial=0))
        while t < steps:
            active = int(np.searchsorted(-self.load, -t))
            span = np.arange(t, min(t + max(WINDOW, self.tokens // active), int(self.load[0])))
            used = span[:, None] < self.load[:active]
            yield np.where(used, self.at[:active] + span[:, None], 0), used
            t += len(span)


def score_batch(net: Network, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each document, without joined counts."""
    dealt = Dealt(net.vocab, ids, sizes)
    out = np.zeros(len(sizes))
    h = np.zeros((len(dealt.load), WIDTH), np.float32)
    for at, used in dealt.windows():
        states, _ = net.states(dealt.input[at], dealt.fresh[at] & used, h[: at.shape[1]], learn=False)
        h = states[-1]
        own = at[used]
        logp, _ = net.outputs(states[used], dealt.word[own], learn=False)
        out += np.bincount(dealt.doc[own], logp, len(sizes))
    return out


class Trainer:
    """Truncated backpropagation with steps scaled by past gradients (Adagrad)."""

    def __init__(self, net: Network):
        self.net = net
        self.past = {f.name: np.full_like(getattr(net.p, f.name), 1e-2) for f in fields(net.p)}

    def _move(self, name: str, g: np.ndarray, scale: np.float32, rows: np.ndarray | slice = slice(None)) -> None:
        g *= scale
        past = self.past[name]
        own = past[rows]
        own += g * g
        if not isinstance(rows, slice):
            past[rows] = own
        g /= np.sqrt(own)
        g *= np.float32(RATE)
        getattr(self.net.p, name)[rows] += g

    def batch(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        dealt = Dealt(self.net.vocab, ids, sizes, LEAST_STEPS)
        h = np.zeros((len(dealt.load), WIDTH), np.float32)
        for at, used in dealt.windows():
            inputs, fresh = dealt.input[at], dealt.fresh[at] & used
            states, trail = self.net.states(inputs, fresh, h[: at.shape[1]])
            h = states[-1].copy()
            _, g = self.net.outputs(states[used], dealt.word[at[used]], learn=True)
            d_out = np.zeros_like(states)
            d_out[used] = g["h"]
            back = self.net.backward(inputs, fresh, trail, d_out)
            scale = np.float32(1 / np.sqrt(max(len(g["h"]), 1)))
            self._move("w", g["w"], scale)
            self._move("u", back["u"], scale)
            self._move("q", back["q"], scale)
            self._move("e", back["e"], scale, back["rows"])
            for own, d in g["y"]:
                self._move("y", d, scale, own)
            self.net.bound()


def _raw(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of a batch: first row, end, texts."""
    texts = [(t or "").encode() for t in batch.column(column).to_pylist()]
    for a, b in slices([len(t) for t in texts], SLICE_BYTES):
        yield a, b, texts[a:b]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all of docs (the end token once a document), added up in each task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate(words)
            order = np.argsort(every)
            own = every[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            return own[first], np.add.reduceat(np.concatenate(counts)[order], first)

        def out(own: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(c)], names=["word", "c"])

        for batch in batches:
            for _, _, texts in _raw(batch, 0):
                own, c = np.unique(tokens(texts)[0], return_counts=True)
                words.append(own)
                counts.append(c.astype(np.int64))
                held += len(own)
                if held > 2 * MEMORY_WORDS:
                    own, c = merged()
                    words, counts, held = [own], [c], len(own)
                    if held > MEMORY_WORDS:
                        yield out(own, c)
                        words, counts, held = [], [], 0
        if words:
            yield out(*merged())

    return docs.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int = HEAD, soft: int = SOFT, classes: int = CLASSES) -> Vocabulary:
    """The head: all words at or above the least count that at most ``head`` words reach."""
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    level = F.floor(F.log2("c") * 32).cast("int").alias("level")
    levels = sorted(((r.level, r.n) for r in counts.groupBy(level).agg(F.count("*").alias("n")).collect()), reverse=True)
    kept, least = 0, None
    for at, n in levels:
        if kept + n > head:
            break
        kept, least = kept + n, at
    rows = counts.where(level >= least).toArrow() if least is not None else pa.table({"word": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    words, c = rows.column("word").to_numpy().astype(np.int64).view(np.uint64), rows.column("c").to_numpy()
    order = np.lexsort((words, -c))
    return Vocabulary(words[order], c[order], int(sums.n or 0), int(sums.v), soft, classes)


NUMBERED = "rid long, doc_id long, ids binary, n_tokens long, base double, n_tail long, word long, k int, kind int"


def numbered(docs: DataFrame, vocab: Vocabulary, rounds: int) -> DataFrame:
    """Documents as numbers of words, with kind their round (``rounds`` where held out), and with kind -1 their words outside the head."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    norm = float(np.log10(vocab.total + 0.5 * (vocab.distinct + 1)))
    names = ["rid", "doc_id", "ids", "n_tokens", "base", "n_tail", "word", "k", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 33
        vocab = shared.value
        other = len(vocab.count)
        base = np.append(np.log10(vocab.count + 0.5), 0.0) - norm
        for batch in batches:
            kinds = batch.column(2)
            for a, b, texts in _raw(batch, 1):
                m = b - a
                words, sizes = tokens(texts)
                every, back = np.unique(words, return_inverse=True)
                ids = vocab.ids(every)[back]
                doc = np.repeat(np.arange(m), sizes)
                tail = np.flatnonzero(ids == other)
                raw, at = ids.tobytes(), np.concatenate(([0], np.cumsum(sizes))) * 4
                rids = rid + np.arange(m)
                rid += m
                none = lambda kind: pa.nulls(m, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids), batch.column(0).slice(a, m), pa.array([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()), pa.array(sizes), pa.array(np.bincount(doc, base[ids], m)), pa.array(np.bincount(doc[tail], minlength=m)), none(pa.int64()), none(pa.int32()), kinds.slice(a, m)],
                    names=names,
                )
                if len(tail):
                    order = np.lexsort((words[tail], doc[tail]))
                    d, w = doc[tail][order], words[tail][order]
                    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1]))))
                    k = np.diff(np.append(first, len(d)))
                    none = lambda kind: pa.nulls(len(first), kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rids[d[first]]), none(pa.int64()), none(pa.binary()), none(pa.int64()), none(pa.float64()), none(pa.int64()), pa.array(w[first].view(np.int64)), pa.array(k.astype(np.int32)), pa.array(np.full(len(first), -1, np.int32))],
                        names=names,
                    )

    kind = F.when(held_out(), F.lit(rounds)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(rounds))).cast("int")
    return docs.select("doc_id", "text", kind.alias("kind")).mapInArrow(run, NUMBERED)


def averaged(rows: DataFrame) -> DataFrame:
    """Rows (weights, n) averaged into one, by rounds of partial sums: the driver sees the weights once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for blob, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(blob, np.float32) * np.float64(k)
                total, n = own if total is None else total + own, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])

    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 8)
        rows = rows.repartition(parts).mapInArrow(add, "weights binary, n long")
    return rows


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Params:
    """Weights after the rounds over all of docs (as ``numbered`` gives them)."""
    sc = docs.sparkSession.sparkContext
    params = Params.fresh(vocab)
    shared_vocab = sc.broadcast(vocab)
    replicas = max(1, -(-vocab.total // REPLICA_TOKENS))
    replica = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(replicas)).alias("replica")
    for i in range(rounds):
        shared = sc.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocab, start = shared_vocab.value, shared.value
            own, parts = None, []

            def trained() -> pa.RecordBatch:
                ids = [np.frombuffer(x, np.int32) for x in parts]
                trainer = Trainer(Network(vocab, start.like(start.flat())))
                trainer.batch(np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
                n = sum(map(len, ids))
                return pa.RecordBatch.from_arrays([pa.array([trainer.net.p.flat().tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])

            for batch in batches:
                for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if at != own:
                        if parts:
                            yield trained()
                        own, parts = at, []
                    parts.append(ids)
            if parts:
                yield trained()

        part = docs.where(F.col("kind") == i).select(replica, "ids", "doc_id", F.xxhash64("ids").alias("h"))
        part = part.repartition(replicas, "replica").sortWithinPartitions("replica", "doc_id", "h").select("replica", "ids")
        rows = averaged(part.mapInArrow(run, "weights binary, n long")).collect()
        n = sum(r.n for r in rows)
        if n:
            params = params.like(sum(np.frombuffer(r.weights, np.float32) * np.float64(r.n) for r in rows) / n)
        release(docs.sparkSession)
    return params


def score_documents(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, params: Params) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document (as ``numbered`` gives them)."""
    sc = docs.sparkSession.sparkContext
    shared_vocab, shared = sc.broadcast(vocab), sc.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared_vocab.value, shared.value)
        rows: list[pa.RecordBatch] = []
        total = 0

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            ids = [np.frombuffer(x, np.int32) for x in table.column("ids").to_pylist()]
            logp = score_batch(net, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
            return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in table.column_names if c != "ids"), pa.array(logp / np.log(10))], names=[*(c for c in table.column_names if c != "ids"), "score"])

        for batch in batches:
            rows.append(batch)
            total += batch.column(0).nbytes // 4
            if total > SCORE_TOKENS:
                yield done()
                rows, total = [], 0
        if rows and sum(map(len, rows)):
            yield done()

    own = docs.where("kind >= 0").select("ids", "rid", "doc_id", "n_tokens", "base", "n_tail")
    rows = own.mapInArrow(run, "rid long, doc_id long, n_tokens long, base double, n_tail long, score double")
    tail = docs.where("kind = -1").select("rid", "word", "k").join(counts.hint("shuffle_merge"), "word", "left")
    logs = tail.groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"))
    out = rows.join(logs.hint("shuffle_merge"), "rid", "left")
    more = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_tokens") - F.col("n_tail") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more - F.col("n_tail") * float(np.log10(vocab.tail_mass))).alias("score"),
    )


def score(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS, soft: int = SOFT, classes: int = CLASSES) -> DataFrame:
    """Learn from the documents that are not held out, score all."""
    counts = stored(count_words(docs.where(~held_out())), "counts")
    release(docs.sparkSession)
    vocab = vocabulary(counts, head, soft, classes)
    rows = stored(numbered(docs, vocab, rounds), "numbered", by="kind")
    params = train(rows, vocab, rounds)
    out = stored(score_documents(rows, counts, vocab, params), "scored")
    discard(counts, rows)
    release(docs.sparkSession)
    return out
