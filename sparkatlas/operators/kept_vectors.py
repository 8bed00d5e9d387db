"""A vector index that is kept: vectors stored by cell, with each cell's centre and radius, extended by deltas.

A dot product with a vector of a cell is at most q.c + |q| r, c the cell's
centre and r its radius (Cauchy and Schwarz). A search scans the cells nearest
to each query until they hold k vectors; the k-th best score found then rules
out every cell whose bound is lower, and the rest are scanned. The result is
exact whatever the centres, which are fitted on at most SAMPLE vectors taken by
a hash of their key. Only the folders of visited cells are read.

The directory of cells is bounded by CELLS, and is all that the driver sees.
Queries go to the cells that they visit in a shuffle, and a cell of many
vectors is split, so neither has to fit into one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkatlas.operators.storage import held, written
from sparkatlas.operators.vectors import _matrix
from sparkatlas.sources.store import Store, Table

TABLES = {
    "vectors": Table("cell int, key long, vec array<float>", "cell", "key"),
    "cells": Table("cell int, n long, radius double", "cell"),
    "centres": Table("cell int, centre array<double>", "cell"),
}
#: Vectors from which centres are fitted, at most, rounds of fitting, and cells at most.
SAMPLE, ROUNDS, CELLS = 1 << 13, 6, 1 << 10
#: Vectors that a task compares with a batch of queries, about, and scores that it holds at a time.
SPLIT, SCORES = 1 << 12, 1 << 20


def fit_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Means of groups of near vectors."""
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        near = (2 * sample @ centres.T - (centres * centres).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=count)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


@dataclass(frozen=True)
class Directory:
    """Cells, their centres, sizes and radii."""

    cell: np.ndarray
    centre: np.ndarray
    n: np.ndarray
    radius: np.ndarray


@dataclass(frozen=True)
class KeptVectors:
    """An index in a store with TABLES; each change gives the next one. Vectors of other lengths than the centres' are left out."""

    store: Store

    @staticmethod
    def at(spark: SparkSession, root: str, buckets: int = 64) -> KeptVectors:
        return KeptVectors(Store(spark, root, TABLES, buckets))

    def _centres(self) -> tuple[np.ndarray, np.ndarray]:
        rows = sorted(self.store.read("centres").collect())
        return np.array([r.cell for r in rows], np.int64), np.array([r.centre for r in rows], np.float64)

    def extend(self, vectors: DataFrame, gone: DataFrame | None = None) -> KeptVectors:
        """Take in vectors (key, vec), in place of older ones of the same key, and drop those of gone (key)."""
        spark, first = self.store.spark, not self.store.manifest.parts
        clean = vectors.where("key IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").select(F.col("key").cast("long").alias("key"), F.col("vec").cast("array<float>").alias("vec"))
        rows: dict[str, DataFrame] = {}
        if first:
            usual = clean.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
            if usual is None:
                return self
            fit = clean.where(F.size("vec") == usual.width)
            thin = max(1, 2 * usual.n // SAMPLE)
            found = fit.where(F.pmod(F.xxhash64("key", F.lit("centre")), F.lit(thin)) == 0).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").collect() or fit.limit(1).collect()
            sample = np.array([r.vec for r in found], np.float64)
            centre = fit_centres(sample, max(1, min(CELLS, len(sample), int(math.sqrt(usual.n) / 2))))
            cell = np.arange(len(centre))
            rows["centres"] = spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(cell, centre)], "cell int, centre array<double>")
        else:
            cell, centre = self._centres()
        shared = spark.sparkContext.broadcast((cell, centre))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, centre = shared.value
            for batch in batches:
                m, at = _matrix(batch.column(1), centre.shape[1])
                home = (2 * m @ centre.T - (centre * centre).sum(axis=1)).argmax(axis=1)
                far = np.sqrt(((m - centre[home]) ** 2).sum(axis=1))
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(cell[home].astype(np.int32)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(far)], names=["cell", "key", "vec", "far"])

        placed = written(clean.mapInArrow(place, "cell int, key long, vec array<float>, far double"), "placed")
        rows["vectors"] = placed
        rows["cells"] = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        void = {}
        if not first:
            keys = clean.select("key")
            void["vectors"] = keys if gone is None else keys.unionByName(gone.select(F.col("key").cast("long").alias("key")))
        return replace(self, store=self.store.commit(rows, void))

    def directory(self) -> Directory | None:
        cell, centre = self._centres()
        if not len(cell):
            return None
        own = {r.cell: r for r in self.store.read("cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()}
        keep = np.array([c in own for c in cell.tolist()])
        cell, centre = cell[keep], centre[keep]
        return Directory(cell, centre, np.array([own[c].n for c in cell.tolist()]), np.array([own[c].radius for c in cell.tolist()]))

    def search(self, queries: DataFrame, k: int = 30, skip_self: bool = False, log: list | None = None) -> DataFrame:
        """query_id, key, score and rank (from 1) of the k best by dot product; ties go by key. log gets the cells scanned in either turn and the folders read."""
        spark = self.store.spark
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        kept = self.directory()
        if kept is None:
            return spark.createDataFrame([], "query_id long, key long, score double, rank int")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<float>").alias("vec"), F.lit(None).cast("double").alias("least"))
        first = written(self._visits(asked, kept, k + skip_self, 1), "first-cells")
        found = written(self._scan(first, kept, k, skip_self, log), "first-found")
        least = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        again = asked.drop("least").join(least.select("query_id", "least"), "query_id", "left").select("query_id", "vec", "least")
        second = written(self._visits(again, kept, k + skip_self, 2), "second-cells")
        both = found.unionByName(self._scan(second, kept, k, skip_self, log))
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _visits(self, asked: DataFrame, kept: Directory, k: int, turn: int) -> DataFrame:
        """(cell, query_id, vec): first the cells of the nearest centres that hold k vectors, then all others whose bound reaches the k-th score."""
        shared = self.store.spark.sparkContext.broadcast(kept)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                q, at = _matrix(batch.column(1), own.centre.shape[1])
                least = batch.column(2).fill_null(-math.inf).to_numpy()[at]
                rows, cells = [], []
                for i, v in enumerate(q):
                    near = own.centre @ v
                    nearest = np.argsort(-near, kind="stable")
                    enough = nearest[: int(np.searchsorted(np.cumsum(own.n[nearest]), k)) + 1]
                    if turn == 1:
                        pick = enough
                    else:
                        bound = near + np.linalg.norm(v) * own.radius
                        pick = np.setdiff1d(np.flatnonzero(bound >= least[i] - 1e-6 * (1 + abs(least[i]))), enough)
                    rows += [at[i]] * len(pick)
                    cells += own.cell[pick].tolist()
                pick = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), batch.column(0).take(pick), batch.column(1).take(pick)], names=["cell", "query_id", "vec"])

        return asked.mapInArrow(run, "cell int, query_id long, vec array<float>")

    def _scan(self, visits: DataFrame, kept: Directory, k: int, skip_self: bool, log: list | None) -> DataFrame:
        """query_id, key and score of the k best of each visited split of a cell."""
        spark = self.store.spark
        cells = held(visits.select("cell").distinct(), "visited")
        buckets = [r.b for r in cells.select(self.store.bucket_of(F.col("cell")).alias("b")).distinct().collect()]
        if log is not None:
            log.append((visits.count(), len(buckets)))
        if not buckets:
            return spark.createDataFrame([], "query_id long, key long, score double")
        splits = spark.createDataFrame([(int(c), max(1, math.ceil(n / SPLIT))) for c, n in zip(kept.cell, kept.n)], "cell int, splits int")
        splits = F.broadcast(splits.join(cells, "cell"))
        width = kept.centre.shape[1]
        rows = self.store.read("vectors", buckets).join(splits, "cell").select("cell", F.pmod(F.xxhash64("key"), "splits").cast("int").alias("split"), F.lit(0).alias("side"), F.col("key").alias("id"), "vec")
        asked = visits.join(splits, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.lit(1).alias("side"), F.col("query_id").alias("id"), "vec")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, keys, m = None, np.zeros(0, np.int64), np.zeros((0, width))
            for batch in batches:
                where = np.column_stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
                for part in np.split(np.arange(len(where)), np.flatnonzero((np.diff(where, axis=0) != 0).any(axis=1)) + 1):
                    if not len(part):
                        continue
                    cell, split, side = where[part[0]]
                    own = batch.slice(part[0], len(part))
                    v, at = _matrix(own.column(4), width)
                    ids = own.column(3).to_numpy()[at]
                    if place != (cell, split):
                        place, keys, m = (cell, split), ids[:0], v[:0]
                    if not side:  # a split's vectors come before its queries
                        keys, m = np.concatenate((keys, ids)), np.vstack((m, v))
                        continue
                    for first in range(0, len(ids), max(1, SCORES // max(1, len(m)))):
                        yield _best(ids[first : first + max(1, SCORES // max(1, len(m)))], v[first : first + max(1, SCORES // max(1, len(m)))] @ m.T, keys, k, skip_self)

        both = rows.unionByName(asked).repartition("cell", "split").sortWithinPartitions("cell", "split", "side")
        return both.mapInArrow(run, "query_id long, key long, score double")


def _best(ids: np.ndarray, scores: np.ndarray, keys: np.ndarray, k: int, skip_self: bool) -> pa.RecordBatch:
    """The k best of each row of scores."""
    out: list[tuple[np.ndarray, ...]] = [(ids[:0], keys[:0], np.zeros(0))]
    for i, s in zip(ids, scores):
        at = np.flatnonzero(keys != i) if skip_self else np.arange(len(keys))
        if len(at) > k:
            at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
            at = at[np.lexsort((keys[at], -s[at]))[:k]]
        out.append((np.full(len(at), i), keys[at], s[at]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "key", "score"])
