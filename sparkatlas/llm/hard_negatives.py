"""Hard negatives: for each anchor and positive, the nearest rows of other labels within a band of scores.

Inner products become distances by one more component: with x' = (x, sqrt(M -
|x|^2)), M the largest squared length, and a' = (a, 0) for an anchor, |x' -
a'|^2 = |a|^2 + M - 2 a.x. Each row's key is the distance of x' to its nearest
pivot; rows are stored sorted by (pivot, key) and cut into blocks. By the
triangle inequality a block's keys bound the distances of its rows to an anchor
from below and above, so a search scans key intervals around the anchor, ring
by ring, until no block outside could hold a better row than the k-th found or
one within the band. The answer is exact whatever the pivots, which are fitted
on at most ``SAMPLE`` rows, taken by a hash of their id. How many blocks a
search skips depends on how far apart clusters lie; independent vectors in many
dimensions are scanned whole.

The directory of blocks has at most ``BLOCKS`` entries and one more for each
partition and pivot; blocks grow beyond that. An anchor goes to the blocks that
it must scan, in a shuffle by block, and each block is compared with a batch of
anchors at a time. Of each block and anchor only the k best are passed on.

Defined cases: rows with a null vec_id, a null label, a null vector, a null or
non-finite component, or a squared length of 2^56 or more (after scaling) take
no part; shorter vectors count as filled up with zeros; rows that repeat a
vec_id take part each for itself, none of them as another row of its own
repeats; ties go by vec_id; a positive without a row in its band has no result;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkatlas.llm.common import discard, stored

SCALE = 256
LONGEST = float(1 << 56)
#: Rows from which the pivots are fitted, at most, and how many pivots there are at most.
SAMPLE, PIVOTS, ROUNDS = 4096, 256, 6
#: Rows of a block, and how many blocks there are before blocks grow.
BLOCK, BLOCKS = 1 << 9, 1 << 16
#: Bounds (anchors times blocks) and scores that a task holds at a time.
CELLS = 1 << 20
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Keys:
    """The pivots, each block's number, pivot and range of keys, the largest squared length and the components."""

    pivots: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    longest: float
    width: int


@dataclass(frozen=True)
class Index:
    """rows: block, pivot, key, vec_id, label and v (32-bit components), sorted; keys: the directory."""

    rows: DataFrame
    keys: Keys


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v = floor(scale * component) of the rows that take part."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + (F.abs(x.cast("double")) * scale + 1) * (F.abs(x.cast("double")) * scale + 1))
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(ok).where(size < LONGEST)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers of any length as a matrix, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lifted(m: np.ndarray, longest: float) -> np.ndarray:
    m = m.astype(np.float64)
    return np.column_stack((m, np.sqrt(np.maximum(0, longest - (m * m).sum(axis=1)))))


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(0, square))


def fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Means of groups of near rows, from evenly taken ones."""
    pivots = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        home = _distances(sample, pivots).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, home, sample)
        n = np.bincount(home, minlength=count)[:, None]
        pivots = np.where(n > 0, sums / np.maximum(n, 1), pivots)
    return pivots


def build(rows: DataFrame, block: int = BLOCK, blocks: int = BLOCKS) -> Index | None:
    """The index of prepared rows, written sorted by pivot and key; None without rows."""
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    stats = rows.agg(F.count("*").alias("n"), F.max(square).alias("longest"), F.max(F.size("v")).alias("width")).first()
    if not stats.n:
        return None
    width, longest = max(1, stats.width), float(stats.longest)
    thin = max(1, 2 * stats.n // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("pivot")), F.lit(thin)) == 0).orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    if not len(sample):
        sample = rows.limit(1).select("v").toArrow().column(0).combine_chunks()
    lifted = _lifted(_matrix(sample, width), longest)
    pivots = spark.sparkContext.broadcast(fit_pivots(lifted, max(1, min(PIVOTS, len(lifted), int(math.sqrt(stats.n) / 4)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(2), width)
            d = _distances(_lifted(m, longest), pivots.value)
            home = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(home)), home]), batch.column(0), batch.column(1), pa.array([r.tobytes() for r in m.astype("<i4")], pa.binary())], names=["pivot", "key", "vec_id", "label", "v"])

    most = max(block, -(-stats.n // blocks))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                if held == most or p != last:
                    number, held, last = number + 1, 0, p
                held += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *batch.columns], names=["block", *batch.schema.names])

    keyed = rows.mapInArrow(place, "pivot int, key double, vec_id long, label long, v binary")
    keyed = keyed.repartitionByRange("pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id")
    table = stored(keyed.mapInArrow(cut, "block long, pivot int, key double, vec_id long, label long, v binary"), "keyed")
    listed = table.groupBy("block").agg(F.min("pivot").alias("pivot"), F.min("key").alias("low"), F.max("key").alias("high")).toPandas().sort_values("block")
    return Index(table, Keys(pivots.value, *(listed[c].to_numpy() for c in ("block", "pivot", "low", "high")), longest, width))


def _bounds(keys: Keys, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance that a row of each block can have to each anchor."""
    d = _distances(np.column_stack((v, np.zeros(len(v)))), keys.pivots)[:, keys.pivot]
    return np.maximum(0, np.maximum(d - keys.high, keys.low - d)), d + keys.high


def _plan(probes: DataFrame, keys: Keys, turn: int) -> DataFrame:
    """A row for each block that a probe scans next, and one without a block that keeps its new reach; none for those done.

    Blocks go by their least distance. While a band has fewer than k rows a
    ring of them is scanned; once all have k, all that could hold a better one.
    """
    shared = probes.sparkSession.sparkContext.broadcast(keys)
    names = ["block", "probe", "vec_id", "label", "v", "lo", "hi", "reach"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ring = max(8, len(own.block) // 16) * 4**turn
        slack = 1e-6 * (1 + math.sqrt(own.longest))
        for batch in batches:
            step = max(1, CELLS // len(own.block))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                v = np.frombuffer(b"".join(part.column(3).to_pylist()), "<i4").reshape(part.num_rows, -1).astype(np.float64)
                near, far = _bounds(own, v)
                square = (v * v).sum(axis=1) + own.longest
                rows, at, reaches = [], [], []
                for i, (lo, hi, full, reach) in enumerate(zip(*(part.column(c).to_pylist() for c in (4, 5, 6, 7)))):
                    if not lo:
                        continue
                    outer = math.sqrt(max(0.0, square[i] - 2 * float(min(lo)))) + slack
                    inner = math.sqrt(max(0.0, square[i] - 2 * float(max(hi)))) - slack
                    open_ = np.flatnonzero((near[i] > reach) & (near[i] <= outer) & (far[i] >= inner))
                    if not len(open_):
                        continue
                    if full or len(open_) <= ring:
                        reach = float(near[i][open_].max())
                    else:
                        reach = float(np.partition(near[i][open_], ring - 1)[ring - 1])
                    blocks = own.block[open_[near[i][open_] <= reach]]
                    at += [None, *blocks.tolist()]
                    rows += [i] * (len(blocks) + 1)
                    reaches += [reach] * (len(blocks) + 1)
                pick = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *pick.columns[:6], pa.array(reaches, pa.float64())], names=names)

    schema = "block long, probe long, vec_id long, label long, v binary, lo array<long>, hi array<long>, reach double"
    return probes.select("probe", "vec_id", "label", "v", "lo", "hi", "full", "reach").mapInArrow(run, schema)


def _vectors(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(kind)


def _best(scores: np.ndarray, probes: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, k: int, same: bool) -> pa.RecordBatch:
    """The k best rows of a block for each probe and band."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
    for s, probe, own, label, los, his in zip(scores, *(probes.column(c).to_pylist() for c in ("probe", "vec_id", "label", "lo", "hi"))):
        fits = (labels == label if same else labels != label) & (ids != own)
        for slot, (lo, hi) in enumerate(zip(los, his)):
            at = np.flatnonzero(fits & (s >= lo) & (s <= hi))
            if len(at) > k:
                at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((ids[at], -s[at]))[:k]]
            out.append((np.full(len(at), probe), np.full(len(at), slot), s[at], ids[at]))
    probe, slot, score, ids = (np.concatenate(c).astype(np.int64) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(probe), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(ids)], names=["probe", "slot", "score", "vec_id"])


def _scan(index: Index, visits: DataFrame, k: int, same: bool) -> DataFrame:
    """probe, slot, score and vec_id of the k best rows of each visited block within each band."""
    width = index.keys.width
    kind = np.float64 if index.keys.longest < 2**53 else np.int64  # sums of products below 2**53 are exact in doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, labels, m = None, [], [], []
        for batch in batches:
            blocks, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in np.split(np.arange(len(blocks)), np.flatnonzero((np.diff(blocks) != 0) | (np.diff(sides) != 0)) + 1):
                if not len(part):
                    continue
                rows = batch.slice(part[0], len(part))
                if not sides[part[0]]:  # the block's rows come first
                    if blocks[part[0]] != block:
                        block, ids, labels, m = blocks[part[0]], [], [], []
                    ids.append(rows.column("vec_id").to_numpy())
                    labels.append(rows.column("label").to_numpy())
                    m.append(_vectors(rows.column("v"), width, kind))
                    continue
                ids, labels, m = [np.concatenate(ids)], [np.concatenate(labels)], [np.vstack(m)]
                step = max(1, CELLS // len(m[0]))
                for first in range(0, len(part), step):
                    probes = rows.slice(first, step)
                    scores = (_vectors(probes.column("v"), width, kind) @ m[0].T).astype(np.int64)
                    yield _best(scores, probes, ids[0], labels[0], k, same)

    wanted = F.broadcast(visits.select("block").distinct())  # at most the directory
    none = F.lit(None).cast("array<long>")
    rows = index.rows.join(wanted, "block", "left_semi").select("block", F.lit(0).alias("side"), F.lit(0).cast("long").alias("probe"), "vec_id", "label", "v", none.alias("lo"), none.alias("hi"))
    both = rows.unionByName(visits.select("block", F.lit(1).alias("side"), "probe", "vec_id", "label", "v", "lo", "hi"))
    dealt = both.repartition("block").sortWithinPartitions("block", "side")
    return dealt.mapInArrow(run, "probe long, slot int, score long, vec_id long")


def search(index: Index, probes: DataFrame, k: int, same: bool, log: list | None = None) -> DataFrame:
    """probe, slot, rank (from 1), score and vec_id of the k best rows of each probe's bands.

    probes: probe, vec_id, label, v, lo and hi (one entry for each band of
    scores, both ends within). same: rows of the probe's label, or of others.
    log gets how many blocks were scanned in each turn.
    """
    spark = probes.sparkSession
    state = probes.withColumn("full", F.lit(False)).withColumn("reach", F.lit(-1.0))
    best = stored(spark.createDataFrame([], "probe long, slot int, rank int, score long, vec_id long"), "best")
    order = Window.partitionBy("probe", "slot").orderBy(F.desc("score"), "vec_id")
    turn, old = 0, []
    while True:
        plan = stored(_plan(state, index.keys, turn), "visits")
        discard(*old)
        visits = plan.where("block IS NOT NULL")
        n = visits.count()
        if log is not None:
            log.append(n)
        if not n:
            discard(plan)
            return best
        found = _scan(index, visits, k, same).unionByName(best.drop("rank"))
        before, best = best, stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("probe", "slot", "rank", "score", "vec_id"), "best")
        last = best.where(F.col("rank") == k).groupBy("probe").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("last"))
        state = plan.where("block IS NULL").join(last, "probe", "left")
        # of a band that has k rows only those at least as good as the k-th matter
        lo = F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.element_at("last", i), x)))
        state = state.withColumn("lo", lo).withColumn("full", F.coalesce(F.size("last"), F.lit(0)) == F.size("lo"))
        turn, old = turn + 1, [plan, before]


def oracle_sql(positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> str:
    """DuckDB SQL of the registered query, every anchor against every row."""
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {positives})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
QUALIFY rank <= {negatives}
"""


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, log: list | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors: vec_id, label, embedding; anchors: which rows are. Of the rows of
    another label whose score is low to high percent of the positive's, the
    first negatives are returned.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build(prepared(vectors), block)
    if index is None:
        return spark.createDataFrame([], schema)
    probes = index.rows.where(anchors).select(F.monotonically_increasing_id().alias("probe"), "vec_id", "label", "v")
    probes = stored(probes, "anchors")
    all_scores = probes.withColumn("lo", F.array(F.lit(LEAST))).withColumn("hi", F.array(F.lit(MOST)))
    first = search(index, all_scores, positives, True, log)
    # without a positive score the band is empty
    first = first.where("score >= 0").withColumn("lo", F.expr(f"(score * {low} + 99) div 100")).withColumn("hi", F.expr(f"score * {high} div 100")).where("lo <= hi")
    bands = first.groupBy("probe").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "lo", "hi"))).alias("bands"))
    bands = stored(probes.join(bands, "probe"), "bands")
    found = search(index, bands.select("probe", "vec_id", "label", "v", F.col("bands.lo").alias("lo"), F.col("bands.hi").alias("hi")), negatives, False, log)
    pairs = bands.select("probe", F.col("vec_id").alias("anchor_id"), F.posexplode("bands").alias("slot", "band"))
    pairs = pairs.select("probe", "slot", "anchor_id", F.col("band.vec_id").alias("positive_id"), F.col("band.score").alias("positive_score"))
    out = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["probe", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
