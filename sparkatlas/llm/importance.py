"""Importance resampling: documents drawn as a target's texts would be.

Features are the runs of consecutive words, each hashed into a bucket. A
bucket's gain tells how much commoner it is in the target's texts than in the
documents; a document weighs as much as its features gain on average, and noise
of the extreme-value kind, fixed by its id, is added to its weight, so that the
highest scores are a draw without replacement.

Scores are read off an array of gains. Every partition sorts its eligible rows
into runs, written in blocks; heads of the blocks split the order of all rows
into pieces of bounded size. A task merges the slices of all runs that fall
into its piece by a tournament tree and gives out ranks from the number of rows
before the piece; pieces past the draw are not read, and the piece in which it
ends stops there. No task sees all rows, and no run is held but by the block.

Defined cases: a null, empty or blank text has no features, and weight 0; a
null doc_id is hashed as an empty string and stands after all others of a tie;
rows that repeat a doc_id are drawn and ranked each for itself, in any order
among equal rows; very long texts are counted whole; an empty table gives an
empty result, an empty target gains by what the documents hold alone; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm.common import discard, stored

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Entries of a sorted run, of a block of it, and about those of a piece that one task merges.
RUN, BLOCK, PIECE = 1 << 18, 1 << 11, 1 << 14
#: Heads of blocks that reach the driver, about.
HEADS = 1 << 16
#: Hashed features that a worker remembers.
REMEMBERED = 1 << 20
LAST = 2**63 - 1
#: Upper case to lower case, and all that is not in a word to a blank.
_CLEAN = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class _Places(dict):
    """Bucket of a feature, remembered for a bounded number of them."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = place = zlib.crc32(feature) % self.buckets
        return place


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_CLEAN).split()


def bucketed(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """row, doc_id, n_words, n_features and places (the features' buckets, little-endian) of every text, written."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(buckets)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sizes, counts, rows = [], [], []
                for text in part.column(1):
                    words = words_of(text.as_py())
                    features = [words] + [[b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, longest + 1)]
                    got = np.concatenate([np.fromiter(map(places.__getitem__, f), kind, len(f)) for f in features])
                    sizes.append(len(words))
                    counts.append(len(got))
                    rows.append(got.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "n_words", "n_features", "places"])

    out = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, places binary")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "buckets")


def tally(places: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket, summed in each partition first."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column(0):
                total += np.bincount(np.frombuffer(own.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in places.select("places").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of each bucket's smoothed share in target and source."""
    n, all_s, all_t = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * all_s / ((float(source[b]) + 1) * all_t))) for b in range(n)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(places: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """row, doc_id, n_words, n_features, weight and score of every row of bucketed()."""
    shared = places.sparkSession.sparkContext.broadcast(gain)
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.fromiter((int(shared.value[own].sum()) // len(own) if len(own) else 0 for own in (np.frombuffer(x.as_py(), kind) for x in batch.column(4))), np.int64, batch.num_rows)
            score = weight + np.fromiter((noise(i, seed) for i in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight), pa.array(score)], names=["row", "doc_id", "n_words", "n_features", "weight", "score"])

    return places.select("row", "doc_id", "n_words", "n_features", "places").mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long, score long")


def merged(runs: Iterable[Iterator[tuple]]) -> Iterator[tuple]:
    """Entries of sorted runs in order, by a tournament tree: each entry taken replays one path of matches."""
    runs = list(runs)
    k, end = len(runs), (math.inf,)
    heads = [next(r, end) for r in runs]
    if not k:
        return
    won, lost = [0] * k + list(range(k)), [0] * k
    for match in range(k - 1, 0, -1):
        a, b = won[2 * match], won[2 * match + 1]
        won[match], lost[match] = (b, a) if heads[b] < heads[a] else (a, b)
    best = won[1] if k > 1 else 0
    while heads[best] is not end:
        yield heads[best]
        heads[best] = next(runs[best], end)
        match = (k + best) // 2
        while match:
            if heads[lost[match]] < heads[best]:
                lost[match], best = best, lost[match]
            match //= 2


_ENTRY = np.dtype([("key", "<i8"), ("doc", "<i8"), ("row", "<i8")])


def sorted_runs(rows: DataFrame, run_size: int = RUN, block: int = BLOCK) -> DataFrame:
    """Sorted runs of (score down, doc_id, row) of each partition, in blocks, written: run, block, n, key, doc, row (of the first) and entries."""

    def blocks(run: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        entries = np.sort(entries, order=["key", "doc", "row"])
        parts = [entries[i : i + block] for i in range(0, len(entries), block)]
        heads = entries[::block]
        yield pa.RecordBatch.from_arrays(
            [pa.array([run] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array([len(p) for p in parts], pa.int64()), *(pa.array(heads[c].astype(np.int64)) for c in ("key", "doc", "row")), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["run", "block", "n", "key", "doc", "row", "entries"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            own = np.empty(batch.num_rows, _ENTRY)
            own["key"], own["row"] = -batch.column(0).to_numpy(), batch.column(2).to_numpy()
            own["doc"] = batch.column(1).fill_null(LAST).to_numpy()
            held.append(own)
            size += len(own)
            if size >= run_size:
                yield from blocks(name, np.concatenate(held))
                name, held, size = name + 1, [], 0
        if size:
            yield from blocks(name, np.concatenate(held))

    out = rows.select("score", "doc_id", "row").mapInArrow(run, "run long, block long, n long, key long, doc long, row long, entries binary")
    return stored(out, "runs")


def splitters(runs: DataFrame, piece: int = PIECE, most: int = HEADS) -> np.ndarray:
    """Entries that cut the order of all rows into pieces, from a bounded number of the blocks' heads."""
    total = runs.agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).first()
    if not total.blocks:
        return np.zeros(0, _ENTRY)
    thin = -(-total.blocks // most)
    heads = runs.where(F.pmod(F.xxhash64("run", "block"), F.lit(thin)) == 0).select("key", "doc", "row").collect()
    heads = np.sort(np.array([tuple(r) for r in heads], _ENTRY), order=["key", "doc", "row"])
    step = max(1, len(heads) * piece // total.n)
    return heads[step::step]


def ranks(rows: DataFrame, draw: int, run_size: int = RUN, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """row and rank (from 1) of the first draw rows by score down, doc_id and row."""
    spark = rows.sparkSession
    runs = sorted_runs(rows, run_size, block)
    cuts = spark.sparkContext.broadcast(splitters(runs, piece))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
                entries = np.frombuffer(raw, _ENTRY)
                # a field-wise search: where each splitter would stand among the entries
                lo, hi = (np.searchsorted(cuts.value["key"], entries["key"][i], side) for i, side in ((0, "left"), (-1, "right")))
                edges = [np.searchsorted(entries, c) for c in cuts.value[lo:hi]]
                for p, (a, b) in enumerate(zip([0, *edges], [*edges, len(entries)]), int(lo)):
                    if a < b:
                        out.append((p, name, at, int(b - a), entries[a:b].tobytes()))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["piece", "run", "block", "n", "entries"])

    slices = stored(runs.select("run", "block", "entries").mapInArrow(cut, "piece long, run long, block long, n long, entries binary"), "run-slices")
    before, total = {}, 0
    for r in sorted(slices.groupBy("piece").agg(F.sum("n").alias("n")).collect()):
        before[r.piece], total = total, total + r.n
    offsets = spark.sparkContext.broadcast(before)
    wanted = max((p for p, n in before.items() if n < draw), default=-1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(piece: int, runs: dict[int, list[bytes]]) -> pa.RecordBatch:
            first = offsets.value[piece]
            out = []
            for entry in merged(iter(np.frombuffer(b"".join(r), _ENTRY).tolist()) for r in runs.values()):
                if first + len(out) == draw:
                    break
                out.append(entry[2])
            return pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(range(first + 1, first + 1 + len(out)), pa.int64())], names=["row", "rank"])

        piece, runs = None, {}
        for batch in batches:
            for p, name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if p != piece:
                    if runs:
                        yield emit(piece, runs)
                    piece, runs = p, {}
                runs.setdefault(name, []).append(raw)
        if runs:
            yield emit(piece, runs)

    dealt = slices.where(F.col("piece") <= wanted).repartition("piece").sortWithinPartitions("piece", "run", "block")
    return dealt.select("piece", "run", "entries").mapInArrow(merge, "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every document.

    Of the N documents with min_words words, floor(percent * N / 100) are drawn.
    """
    places = bucketed(docs, buckets, longest)
    # the target's rows need no ids
    aim = bucketed(target.select(F.lit(0).alias("doc_id"), "text"), buckets, longest)
    table = stored(scored(places, gains(tally(places, buckets), tally(aim, buckets)), seed), "scores")
    discard(places, aim)
    eligible = table.where(F.col("n_words") >= min_words)
    drawn = ranks(eligible, eligible.count() * percent // 100)
    return table.join(drawn, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def oracle_sql(percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """DuckDB SQL of resample() on single words, with the checksum of each distinct word worked out bit by bit."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    fold = "list_reduce(range(8), lambda c, k: " + step + ", n)"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, {word}) AS ws FROM documents),
b AS (SELECT regexp_extract_all({lower}, {word}) AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(ws) AS w FROM b),
tab AS MATERIALIZED (SELECT list({fold} ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
seen AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
place AS (SELECT w, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) % {buckets} AS p FROM seen, tab),
s AS (SELECT p, count(*) AS n FROM dw JOIN place USING (w) GROUP BY p),
t AS (SELECT p, count(*) AS n FROM bw JOIN place USING (w) GROUP BY p),
gain AS (SELECT p, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM dw) + {buckets}.0::DOUBLE) / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM bw) + {buckets}.0::DOUBLE)))) AS BIGINT) AS g FROM s FULL JOIN t USING (p)),
mean AS (SELECT doc_id, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM dw JOIN place USING (w) JOIN gain USING (p) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN mean USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
