"""Similar pairs by an index of banded random hyperplanes, each candidate verified exactly.

A vector's signature says on which side of each hyperplane it lies; bands of
its bits are buckets, and vectors that share one are compared by the bits in
which their whole signatures differ. The few pairs that could reach the
threshold are looked up and their dot product is worked out. ``plan`` takes the
number of bits and bands that costs least among those that find a pair at the
threshold with the asked probability; pairs above it are found more surely.
What is compared grows with n^r, r = log p / log 1/2, p the chance that a pair
at the threshold lies on one side of a hyperplane (0.28 at 0.85), not with n^2.

Equal vectors are one vector with several keys. Large buckets are cut into
chunks that meet two at a time, so no task holds a bucket; a pair is passed on
by the first band that it shares only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.functions.vectors import dot, normalised
from sparkatlas.operators.storage import held, written
from sparkatlas.operators.vectors import _matrix

#: Rows of a bucket that are compared with one another at a time.
CHUNK = 1 << 11
#: What dealing a vector to a bucket costs, in comparisons.
DEAL = 20.0
#: Standard deviations by which a signature may differ more than a pair at the threshold would on average.
SLACK = 4.0
#: Hyperplanes that a signature knows at least.
BITS = 256


#: Vectors that are signed at a time.
SIGNED = 1 << 9


@dataclass(frozen=True)
class Bands:
    bits: int
    bands: int

    @property
    def spare(self) -> int:
        """64-bit words of hyperplanes beyond those of the bands, so that a signature has BITS at least."""
        return max(0, -(-(BITS - self.bits * self.bands) // 64))

    @property
    def words(self) -> int:
        """64-bit words of a signature; a band never crosses two."""
        return -(-self.bands // (64 // self.bits)) + self.spare

    @property
    def planes(self) -> int:
        return self.bits * self.bands + 64 * self.spare


def same_side(threshold: float) -> float:
    return 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi


def plan(n: int, threshold: float, recall: float) -> Bands:
    """The cheapest bands that find a pair at the threshold with this probability."""
    p, best, least = same_side(threshold), None, math.inf
    for bits in range(1, 33):
        hit = p**bits
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        cost = bands * (DEAL + n / 2**bits)
        if cost < least:
            best, least = Bands(bits, bands), cost
    return best


def signatures(m: np.ndarray, bands: Bands, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature words of each row, and its buckets, one a band."""
    planes = np.random.default_rng(seed).standard_normal((m.shape[1], bands.planes))
    side, cut, each = (m @ planes > 0).astype(np.uint64), bands.bits * bands.bands, 64 // bands.bits
    value = (side[:, :cut].reshape(len(m), bands.bands, bands.bits) << np.arange(bands.bits, dtype=np.uint64)).sum(axis=2).astype(np.uint64)
    words = np.zeros((len(m), bands.words), np.uint64)
    for b in range(bands.bands):
        words[:, b // each] |= value[:, b] << np.uint64(b % each * bands.bits)
    if bands.spare:
        words[:, -bands.spare :] = (side[:, cut:].reshape(len(m), bands.spare, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2).astype(np.uint64)
    return words, value.astype(np.int64) + (np.arange(bands.bands, dtype=np.int64) << 32)


def near_pairs(vectors: DataFrame, threshold: float = 0.85, recall: float = 0.95, seed: int = 7, bands: Bands | None = None, log: dict | None = None) -> DataFrame:
    """(a, b, similarity) of pairs a < b of vectors whose cosine is at or above the threshold.

    Vectors without length have no pairs. log gets the number of comparisons
    and of candidates.
    """
    spark = vectors.sparkSession
    clean = vectors.where("key IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").select("key", normalised(F.col("vec")).alias("vec"))
    clean = clean.where(dot(F.col("vec"), F.col("vec")) > 0)
    # of equal vectors the least key stands for all
    single = written(clean.groupBy("vec").agg(F.min("key").alias("key"), F.size(F.collect_list("key")).alias("copies")).select("key", "vec", "copies"), "distinct-vectors")
    n = single.count()
    bands = bands or plan(n, threshold, recall)
    widths = [r.w for r in single.select(F.size("vec").alias("w")).distinct().collect()]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(first, SIGNED) for b in batches for first in range(0, b.num_rows, SIGNED)):
            for width in widths:
                m, at = _matrix(batch.column(1), width)
                words, buckets = signatures(m, bands, seed + width)
                keys = batch.column(0).take(pa.array(at))
                ends = pa.array(np.arange(len(at) + 1) * bands.bands, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([width] * len(at), pa.int32()), keys, pa.array([w.tobytes() for w in words], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(buckets.ravel()))], names=["width", "key", "sig", "buckets"])

    signed = written(single.select("key", "vec").mapInArrow(sign, "width int, key long, sig binary, buckets array<long>"), "signatures")
    rows = signed.select("width", "key", "sig", F.explode("buckets").alias("bucket"))
    sizes = rows.groupBy("width", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    large = held(sizes.where(F.col("n") > CHUNK).select("width", "bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "large-buckets")
    dealt = rows.join(large, ["width", "bucket"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
    # a row meets the chunks up to its own, and waits in its own for those after it
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.greatest(c, F.col("own")).alias("hi"), F.least(c, F.col("own")).alias("lo")))
    dealt = dealt.select("width", "bucket", F.explode(tiles).alias("tile"), "own", "key", "sig").select("width", "bucket", "tile.hi", "tile.lo", "own", "key", "sig")
    p, total = same_side(threshold), bands.planes
    most = total * (1 - p) + SLACK * math.sqrt(total * p * (1 - p))
    compared = spark.sparkContext.accumulator(0)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, count = 64 // bands.bits, 0
        mask = np.uint64((1 << bands.bits) - 1)
        place, keys, own, sigs = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, bands.words), np.uint64)
        for batch in batches:
            where = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            for part in np.split(np.arange(len(where)), np.flatnonzero((np.diff(where, axis=0) != 0).any(axis=1)) + 1):
                if not len(part):
                    continue
                k, o = batch.column(5).to_numpy()[part], batch.column(4).to_numpy()[part]
                s = np.frombuffer(b"".join(batch.column(6).take(pa.array(part)).to_pylist()), np.uint64).reshape(len(part), -1)
                if tuple(where[part[0]]) != place:
                    place, keys, own, sigs = tuple(where[part[0]]), k[:0], o[:0], s[:0]
                _, bucket, hi, lo = place
                band = bucket >> 32
                base = len(keys)
                keys, own, sigs = np.concatenate((keys, k)), np.concatenate((own, o)), np.vstack((sigs, s))
                for i in range(len(part)):
                    # with the rows before it; of two chunks only rows of the other
                    before = np.arange(base + i) if hi == lo else np.flatnonzero(own[: base + i] != o[i])
                    if not len(before):
                        continue
                    count += len(before)
                    differ = sigs[before] ^ s[i]
                    before = before[np.bitwise_count(differ).sum(axis=1) <= most]
                    if not len(before):
                        continue
                    differ = sigs[before] ^ s[i]
                    first = np.ones(len(before), bool)
                    for b in range(band):
                        first &= (differ[:, b // each] >> np.uint64(b % each * bands.bits)) & mask != 0
                    other = keys[before[first]]
                    if len(other):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, k[i])), pa.array(np.maximum(other, k[i]))], names=["a", "b"])
        compared.add(count)

    tiled = dealt.repartition("width", "bucket", "hi", "lo").sortWithinPartitions("width", "bucket", "hi", "lo", "key")
    found = written(tiled.select("width", "bucket", "hi", "lo", "own", "key", "sig").mapInArrow(meet, "a long, b long"), "candidates")
    x, y = (single.select(F.col("key").alias(c), F.col("vec").alias(f"v{c}")) for c in "ab")
    pairs = found.join(x, "a").join(y, "b").select("a", "b", dot(F.col("va"), F.col("vb")).alias("similarity")).where(F.col("similarity") >= threshold)
    if log is not None:
        log["vectors"], log["bands"], log["candidates"], log["compared"] = n, bands, found.count(), compared.value
    same = clean.join(single.where("copies > 1").withColumnRenamed("key", "least"), "vec").select("least", "key")
    return _with_copies(pairs, written(same, "copies"))


def _with_copies(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """Pairs of every key, from those of the least keys of equal vectors and the members (least, key) of such."""
    other = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c))
    wide = pairs
    for c in "ab":
        wide = wide.join(same.select(F.col("least").alias(c), F.col("key").alias(f"_{c}")), c, "left")
    wide = wide.select(F.least(other("a"), other("b")).alias("a"), F.greatest(other("a"), other("b")).alias("b"), "similarity")
    inner = same.join(same.select("least", F.col("key").alias("other")), "least").where("key < other").select(F.col("key").alias("a"), F.col("other").alias("b"), F.lit(1.0).alias("similarity"))
    return wide.unionByName(inner)
