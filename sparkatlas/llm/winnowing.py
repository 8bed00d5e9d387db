"""Document fingerprints by winnowing, and likenesses of neighbours.

Every run of GRAM code points has a hash; of each window of WINDOW consecutive
hashes the least is kept, the rightmost of equals, with its position. A passage
of GRAM + WINDOW - 1 code points that two texts share therefore leaves at least
one common hash in both fingerprints. Texts of fewer grams than a window are
one window; texts shorter than a gram are one gram.

A fingerprint is written as 16 hex digits for each kept gram, in order: 8 for
the hash, 8 for the position. The likeness of two is the Jaccard likeness of
their sets of hashes; two empty ones are alike (1).

``compare`` also fingerprints each text with its last quarter replaced by the
beginning of the next document, by ascending doc_id. Documents are dealt to
ranges of ids; each range gets its successor's first row besides, so that
neighbours meet without sorting the table in one task, and streams in order.

Defined cases: a null text is empty, and an empty text has an empty
fingerprint; a null doc_id comes before all others, and rows that repeat one
follow each other in order of their texts; a document that stands alone is its
own next one; very long texts are handled whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm.common import text_of
from sparkatlas.llm.textcore import Spans, mix, slices, sliding

GRAM, WINDOW = 8, 24
#: Characters that a task fingerprints at a time (or one text).
SLICE_CHARS = 1 << 20
#: Documents of a range of ids, about, and how many ranges there are at most.
RANGE_DOCS, RANGES = 1 << 11, 1 << 16
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
Print = tuple[np.ndarray, np.ndarray]


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[Print]:
    """Kept hashes and their positions (both 32 bit) of every text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        spans = Spans(mix(points + np.uint64(1)))
    # the place counts down, so that the least of equal hashes is the rightmost
    grams = spans.every(gram)
    packed = (grams & _HIGH) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    n_grams = sizes - gram + 1
    least = sliding(packed, window, np.minimum)
    full = np.flatnonzero(n_grams >= window)
    n_windows = n_grams[full] - window + 1
    kept = least[np.arange(n_windows.sum()) + np.repeat(bounds[full] - np.cumsum(n_windows) + n_windows, n_windows)]
    kept = kept[np.flatnonzero(np.diff(kept, prepend=_LOW))] if len(kept) else kept
    part = np.flatnonzero((n_grams >= 1) & (n_grams < window))
    if len(part):
        edges = np.column_stack((bounds[part], bounds[part] + n_grams[part])).ravel()
        kept = np.concatenate((kept, np.minimum.reduceat(np.append(packed, ~np.uint64(0)), edges)[::2]))
    tiny = np.flatnonzero((sizes > 0) & (n_grams < 1))
    whole = (spans(bounds[tiny], bounds[tiny + 1]) & _HIGH) | (_LOW - bounds[tiny].astype(np.uint64))
    kept = np.concatenate((kept, whole))
    at = (_LOW - (kept & _LOW)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, hashes = at[order], (kept[order] >> np.uint64(32)).astype(np.uint32)
    edges = np.searchsorted(at, bounds)
    return [(hashes[a:b], (at[a:b] - start).astype(np.uint32)) for a, b, start in zip(edges[:-1], edges[1:], bounds)]


def written_out(print_: Print) -> str:
    return np.column_stack(print_).astype(">u4").tobytes().hex()


def read_back(fingerprint: str) -> Print:
    both = np.frombuffer(bytes.fromhex(fingerprint), ">u4").reshape(-1, 2)
    return both[:, 0].astype(np.uint32), both[:, 1].astype(np.uint32)


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first characters of another (or all)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars and fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                prints = [written_out(p) for p in fingerprints(texts[a:b], gram, window)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(prints, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, range_docs: int = RANGE_DOCS) -> DataFrame:
    """Documents in ranges of ids: range, tail, doc_id and text, in order; tail marks the copy of the first row after the range."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    count = rows.count()
    n = min(RANGES, -(-count // range_docs))
    shares = [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 10 * n)).first()[0] if shares else []
    shared = spark.sparkContext.broadcast(np.unique(np.array(cuts or [], np.int64)))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(shared.value, ids.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(ids.isna(), -1, at).astype(np.int32))

    rows = rows.withColumn("range", place("doc_id"))
    heads = sorted(rows.groupBy("range").agg(F.min("doc_id").alias("doc_id")).collect())
    if not heads:
        return rows.select("range", F.lit(False).alias("tail"), "doc_id", "text")
    first = spark.createDataFrame([(before.range, own.doc_id) for before, own in zip([heads[-1], *heads[:-1]], heads)], "before int, head long")
    head_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("head")))
    head_rows = head_rows.groupBy("before", "doc_id").agg(F.min("text").alias("text"))
    both = rows.select("range", F.lit(False).alias("tail"), "doc_id", "text").unionByName(head_rows.select(F.col("before").alias("range"), F.lit(True).alias("tail"), "doc_id", "text"))
    return both.repartition("range").sortWithinPartitions("range", "tail", F.asc_nulls_first("doc_id"), "text")


def compare(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, range_docs: int = RANGE_DOCS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row whose next one is not seen yet
        for batch in batches:
            ranges, tails, ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                prints = fingerprints(texts[a:b], gram, window)
                rows = [] if last is None else [last]
                rows += [(r, tail, i, t, p, frozenset(p[0].tolist())) for r, tail, i, t, p in zip(ranges[a:b], tails[a:b], ids[a:b], texts[a:b], prints)]
                last = rows[-1]
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1]]
                changed = [edited(x[3], y[3]) for x, y in pairs]
                again = fingerprints(changed, gram, window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in pairs], pa.int64()),
                        pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                        pa.array([written_out(x[4]) for x, _ in pairs], pa.string()),
                        pa.array([written_out(p) for p in again], pa.string()),
                        pa.array([likeness(x[5], frozenset(p[0].tolist())) for (x, _), p in zip(pairs, again)], pa.float64()),
                        pa.array([likeness(x[5], y[5]) for x, y in pairs], pa.float64()),
                    ],
                    names=names,
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, range_docs).select("range", "tail", "doc_id", "text").mapInArrow(run, schema)
