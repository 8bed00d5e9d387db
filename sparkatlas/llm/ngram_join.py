"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

A document is the set of its distinct word shingles. Two sets of sizes in one
band whose Jaccard similarity reaches the threshold differ in at most ``H``
shingles, so if the universe of shingles is hashed into more segments than
that, some segments of the two sets are the same. How the segments of a band
are indexed is an allocation by cost:

* small sets get few segments, each indexed whole and with every one-deletion
  neighbour, which finds segments that differ in one shingle;
* larger sets get ``H + 1 + spare`` segments, so at least ``spare + 1`` are
  equal. A set leaves out its smallest segments, which match by chance most
  easily: all up to a size that at most ``spare`` of them have. One equal
  segment always remains in both sets.

Sets that share an entry are tied by a star (never all pairs). Within a star,
linked sets of a larger band must agree on ``spare + 1`` segments: codes of two
bytes a segment tell which can, and only those stay together. What is left is
verified exactly, set against set, on all shingles of the whole texts, and the
components of the verified links are what is returned. Equal sets (by 128 bits)
are collapsed before anything is tied.

No group gathers in one task, and none is compared pair by pair as a whole: a
group above ``BLOCK`` sets is cut into blocks, each verified by itself; then the
blocks' components are joined through one set of each; only sets outside the
group's largest component are then compared with all others. What travels for
that are shingle hashes, once a set and step.

Defined cases: null, empty and blank texts have an empty set and are linked
with nothing; a text of fewer words than a shingle is one shingle; equal texts
are linked; repeated rows are linked like copies; ties (rows of equal doc_id and
other texts) are sets of their own; a null doc_id never becomes a component's id
unless the component has no other; very long texts are compared whole; an empty
table gives an empty result; extra columns are ignored by ``join`` and kept by
``one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm import textcore
from sparkatlas.llm.common import beside, discard, release, stored, unused
from sparkatlas.llm.components import components
from sparkatlas.llm.textcore import mix, slices

SHINGLE = 4
PERCENT = 85
SLICE_BYTES = 2 << 20
#: Largest size of the bands that use deletion neighbours throughout.
SMALL = 24
BLOCK = 1500
#: Sets of a group whose codes are compared in one task.
CODE_BLOCK = 8000
#: Sets that a task remembers so as not to index copies twice.
SEEN = 500_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EMPTY = np.uint64(0x5851F42D4C957F2D)


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and where each text's begin."""
    _, _, _, values, bounds = textcore.words([t.translate(_LOWER) for t in texts])
    spans = textcore.Spans(values)
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(texts)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + bounds[text]
    grams = spans(start, np.minimum(start + size, bounds[text + 1]))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[keep], text[keep]
    return grams, np.searchsorted(text, np.arange(len(texts) + 1))


def differences(larger: int, percent: int) -> int:
    """Most shingles in which linked sets of at most this size can differ."""
    return (100 - percent) * 2 * larger // (100 + percent)


@lru_cache(maxsize=8)
def bands(percent: int) -> np.ndarray:
    """Largest size of each band; sizes of linked sets lie in one band or in neighbours."""
    tops = [differences_free(percent)]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, (tops[-1] + 1) * 100 // percent))
    return np.array(tops)


def differences_free(percent: int) -> int:
    """The size up to which linked sets are equal."""
    size = 1
    while differences(size + 1, percent) == 0:
        size += 1
    return size


def _bands_of(size: int, percent: int) -> list[tuple[int, int]]:
    """Bands of a set of this size, with their largest sizes: its own, and the next where larger partners may be."""
    tops = bands(percent)
    first, last = np.searchsorted(tops, (size, size * 100 // percent))
    return [(b, int(tops[b])) for b in range(max(int(first), 1), int(last) + 1)]


def _allocation(top: int, percent: int) -> tuple[bool, int, int]:
    """Whether a band indexes deletion neighbours, its spare segments and its segments."""
    most = differences(top, percent)
    if top <= SMALL:
        return True, 0, (most + 2) // 2
    spare = max(2, most // 4)
    return False, spare, most + 1 + spare


def _segments(grams: np.ndarray, band: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spread shingles and their segment, and each segment's sum and size."""
    spread = mix(grams + np.uint64(band + 1) * np.uint64(0x9E3779B9))
    segment = ((spread >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(count, np.uint64)
    np.add.at(sums, segment, mix(spread))
    return spread, segment, sums, np.bincount(segment, minlength=count)


def entries(grams: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of one set; the lowest bit marks those of bands with deletion neighbours."""
    return np.concatenate([_band_entries(grams, b, top, percent) for b, top in _bands_of(len(grams), percent)] or [np.zeros(0, np.uint64)])


def _band_entries(grams: np.ndarray, band: int, top: int, percent: int) -> np.ndarray:
    small, spare, count = _allocation(top, percent)
    spread, segment, sums, sizes = _segments(grams, band, count)
    label = mix(np.arange(count, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(32)))
    whole = mix(sums ^ label) + sizes.astype(np.uint64)
    if small:
        less = mix((sums[segment] - mix(spread)) ^ label[segment]) + (sizes[segment] - 1).astype(np.uint64)
        return np.unique(np.concatenate((whole, less)) | np.uint64(1))
    # sizes of equal segments are equal, so whichever set leaves out fewer sizes keeps one that the other keeps too
    return whole[sizes >= np.partition(sizes, spare)[spare]] & ~np.uint64(1)


def codes(grams: np.ndarray, percent: int) -> list[dict]:
    """Two-byte codes of all segments of one set, for each of its larger bands."""
    out = []
    for band, top in _bands_of(len(grams), percent):
        small, _, count = _allocation(top, percent)
        if not small:
            _, _, sums, sizes = _segments(grams, band, count)
            out.append({"band": band, "codes": (mix(sums) + sizes.astype(np.uint64)).astype(np.uint16).tobytes()})
    return out


def _prints(grams: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    pad = np.zeros(1, np.uint64)
    a = np.concatenate((pad, np.cumsum(mix(grams))))
    b = np.concatenate((pad, np.cumsum(mix(grams ^ _EMPTY))))
    return mix(a[start[1:]] - a[start[:-1]]), mix(b[start[1:]] - b[start[:-1]])


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(column).to_pylist()]


def sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, th, n_shingles, the set's print of 64 bits (a) and of 128 (sid), and the segment codes of each document's set."""
    kind = pa.list_(pa.struct([("band", pa.int32()), ("codes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, 1)
            for x, y in slices([len(t) for t in texts], SLICE_BYTES):
                grams, start = shingles(texts[x:y], size)
                a, b = _prints(grams, start)
                own = [codes(grams[i:j], percent) for i, j in zip(start[:-1], start[1:])]
                sid = np.stack((a, b), 1).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, y - x), batch.column(2).slice(x, y - x), pa.array(np.diff(start)), pa.array(a.view(np.int64)), pa.array([sid[16 * i : 16 * i + 16] for i in range(y - x)], pa.binary()), pa.array(own, kind)],
                    names=["doc_id", "th", "n_shingles", "a", "sid", "bands"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n_shingles long, a long, sid binary, bands array<struct<band:int,codes:binary>>")


def ties(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(x, y, small): sets (by fingerprint) tied by a shared entry, as stars; small: by one with deletion neighbours."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(dict.fromkeys(_texts(batch, 0)))
            seen: set[int] = set()
            for x, y in slices([len(t) for t in texts], SLICE_BYTES):
                grams, start = shingles(texts[x:y], size)
                ids = _prints(grams, start)[0]
                made, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                for i, one in enumerate(ids.tolist()):
                    if one not in seen and start[i + 1] > start[i]:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(one)
                        own = entries(grams[start[i] : start[i + 1]], percent)
                        made.append(own)
                        who.append(np.full(len(own), ids[i]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64)), pa.array(np.concatenate(who).view(np.int64))], names=["entry", "id"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_entry, tail_hub = None, None
        for batch in batches:
            entry, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(entry):
                continue
            first = np.concatenate(([True], entry[1:] != entry[:-1]))
            hub = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))].copy()
            if tail_entry is not None and entry[0] == tail_entry:
                hub[: int(np.searchsorted(entry, entry[0], "right"))] = tail_hub
            tail_entry, tail_hub = entry[-1], hub[-1]
            far = hub != ids
            if far.any():
                pairs = np.unique(np.stack((hub[far], ids[far], entry[far] & 1), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 2] == 1)], names=["x", "y", "small"])

    made = docs.where("text IS NOT NULL").select("text").mapInArrow(index, "entry long, id long")
    return made.repartition("entry").sortWithinPartitions("entry", "id").mapInArrow(stars, "x long, y long, small boolean").distinct()


class Spanning:
    """Collects links between n nodes; keeps those that join what was apart."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, node: int, others: np.ndarray) -> None:
        own = np.unique(self.label[np.append(others, node)])
        if len(own) > 1:
            self.links += [(int(own[0]), int(x)) for x in own[1:]]
            self.label[np.isin(self.label, own[1:])] = own[0]


def verified(sets_of: list[np.ndarray], percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the sets; left: verify only between the first so many and the others."""
    n = len(sets_of)
    sizes = np.array([len(s) for s in sets_of])
    owner = np.repeat(np.arange(n), sizes)
    tokens, column = np.unique(np.concatenate(sets_of), return_inverse=True)
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, (first, first + 2048))
        block = np.zeros((n, 2048), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        common += block @ block.T
    out = Spanning(n)
    for i in range(n if left is None else left):
        begin = i + 1 if left is None else left
        row = common[i, begin:]
        linked = np.flatnonzero(100 * row >= percent * (sizes[i] + sizes[begin:] - row))
        if len(linked):
            out.add(i, linked + begin)
    return out.links


def alike(matrix: np.ndarray, least: int, left: int | None = None) -> list[tuple[int, int]]:
    """Pairs that span the components of rows that agree on at least so many columns; left as in verified."""
    n, m = matrix.shape
    columns = np.ascontiguousarray(matrix.T)
    out = Spanning(n)
    last, begin = (n, 0) if left is None else (left, left)
    step = max(1, (8 << 20) // max(n, 1))
    for first in range(0, last, step):
        rows = slice(first, min(first + step, last))
        same = np.zeros((rows.stop - first, n - begin), np.uint16)
        for c in columns:
            same += c[rows, None] == c[None, begin:]
        for i, own in enumerate(same, first):
            found = np.flatnonzero(own >= least) + begin
            found = found[found > i] if left is None else found
            if len(found):
                out.add(i, found)
    return out.links


def _placed(member: DataFrame, keys: list[str], block: int, name: str, carried: list[str]) -> DataFrame:
    """Rows of member for each pair of blocks (low, high) of their group that own, their block (by name), is in; a group of one block has one pair."""
    many = member.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("many")).where("many > 1")
    placed = member.join(beside(many), keys, "left").withColumn("blocks", F.coalesce("many", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64(name), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select(*keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *carried)


def tightened(member: DataFrame, tied: DataFrame, percent: int) -> DataFrame:
    """(x, y): sets of one star and larger band that agree on enough segments to be linked, spanning their components."""
    tops = bands(percent)
    star = tied.where("NOT small").select(F.col("x").alias("grp"), F.col("y").alias("a"))
    star = star.unionByName(star.select("grp", F.col("grp").alias("a")).distinct())
    rows = member.join(star, "a").select("grp", "a", F.explode("bands").alias("x")).select("grp", "a", "x.band", "x.codes")
    placed = _placed(rows, ["grp", "band"], CODE_BLOCK, "codes", ["a", "codes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, found in _by_group(batches, 4):
            low, high, band = key[2], key[3], key[1]
            found.sort(key=lambda r: r[0] != low)
            left = None if low == high else sum(r[0] == low for r in found)
            _, spare, _ = _allocation(int(tops[band]), percent)
            names = np.array([r[1] for r in found])
            pairs = alike(np.stack([np.frombuffer(r[2], np.uint16) for r in found]), spare + 1, left)
            x, y = (names[[p[k] for p in pairs]] if pairs else names[:0] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

    order = ["grp", "band", "low", "high"]
    return placed.select(*order, "own", "a", "codes").repartition(*order).sortWithinPartitions(*order).mapInArrow(check, "x long, y long")


def _by_group(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal leading columns: (key, other columns), of at least two rows."""
    key, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:n_keys] != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = r[:n_keys], []
            rows.append(r[n_keys:])
    if len(rows) > 1:
        yield key, rows


def _shingled(texts: DataFrame, size: int) -> DataFrame:
    """(grp, sid, grams) of rows (grp, sid, text): the sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _texts(batch, 2)
            for x, y in slices([len(t) for t in raw], SLICE_BYTES):
                grams, start = shingles(raw[x:y], size)
                blobs = [grams[i:j].tobytes() for i, j in zip(start[:-1].tolist(), start[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), pa.array(blobs, pa.binary())], names=["grp", "sid", "grams"])

    return texts.select("grp", "sid", "text").mapInArrow(run, "grp long, sid binary, grams binary")


def _verify(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(x, y): links between sets with equal keys that span the components.

    rows: keys, side, sid, grams; only sets of different sides (0 and 1) are
    compared, or all where side is null.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            order = sorted(held, key=lambda k: (k[0] or 0, k[1]))
            left = sum(k[0] == 0 for k in order) if any(k[0] is not None for k in order) else None
            if len(order) > 1 and left not in (0, len(order)):
                found = verified([held[k] for k in order], percent, left)
                yield pa.RecordBatch.from_arrays([pa.array([order[i][1] for i, _ in found], pa.binary()), pa.array([order[j][1] for _, j in found], pa.binary())], names=["x", "y"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:n] != key:
                    yield from done()
                    key, held = r[:n], {}
                held[r[n], r[n + 1]] = np.frombuffer(r[n + 2], np.uint64)
        yield from done()

    return rows.select(*keys, "side", "sid", "grams").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "x binary, y binary")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with comp, the component of their sid under the links found."""
    comp = components(found).select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    return rows.join(comp.hint("shuffle_merge"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))


def large_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links that span the components of groups (grp, sid, grams) of more than a block."""
    whole = F.lit(None).cast("int").alias("side")
    count = rows.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = stored(rows.join(beside(count), "grp").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")), "large")
    inner = stored(_verify(rows.select("*", whole), ["grp", "block"], percent), "inner")
    # one set of each component of a block speaks for it
    own = _labelled(rows.select("grp", "block", "blocks", "sid"), inner)
    heads = own.groupBy("grp", "block", "comp").agg(F.min("sid").alias("sid")).select("grp", "sid")
    heads = rows.select("grp", "sid", "grams").join(heads, ["grp", "sid"])
    pairs = _placed(heads, ["grp"], BLOCK, "sid", ["sid", "grams"])
    side = F.when(F.col("low") != F.col("high"), (F.col("own") == F.col("high")).cast("int")).alias("side")
    found = stored(inner.unionByName(_verify(pairs.select("*", side), ["grp", "low", "high"], percent)), "joined")
    # sets outside the group's largest component meet all others
    own = stored(_labelled(rows.select("grp", "blocks", "sid"), found), "labelled")
    sizes = own.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    top = sizes.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    top = top.where("all > top.n").select("grp", F.col("top.comp").alias("most"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("minors"))
    top = beside(top)
    left = own.join(top, "grp").where("comp <> most").select("grp", "sid", F.pmod(F.xxhash64("sid"), F.col("minors")).cast("int").alias("low"), F.sequence(F.lit(0), F.col("blocks") - 1).alias("high"))
    left = rows.select("grp", "sid", "grams").join(left, ["grp", "sid"]).withColumn("high", F.explode("high")).withColumn("side", F.lit(0))
    right = rows.join(top, "grp").select("grp", "sid", "grams", F.explode(F.sequence(F.lit(0), F.col("minors") - 1)).alias("low"), F.col("block").alias("high"), F.lit(1).alias("side"))
    both = left.unionByName(right)
    out = stored(found.unionByName(_verify(both, ["grp", "low", "high"], percent)), "large-links")
    discard(rows, inner, found, own)
    return out


def links(docs: DataFrame, table: DataFrame, tied: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(x, y): links between distinct sets (by sid) that span every component."""
    distinct = table.where("n_shingles > 0").groupBy("a", "sid").agg(F.min(F.struct("doc_id", "th", "bands")).alias("first")).select("a", "sid", "first.*")
    ends = tied.select(F.col("x").alias("a")).unionByName(tied.select(F.col("y").alias("a"))).distinct()
    member = stored(distinct.join(ends.hint("shuffle_merge"), "a"), "members")
    tight = stored(tightened(member, tied, percent).unionByName(tied.where("small").select("x", "y")).distinct(), "tight")
    release(docs.sparkSession)
    group = components(tight).select(F.col("node").alias("a"), F.col("component").alias("grp"))
    member2 = member.join(group.hint("shuffle_merge"), "a").select("grp", "sid", "doc_id", "th")
    count = member2.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    member2 = stored(member2.join(beside(count), "grp", "left").withColumn("large", F.col("n").isNotNull()).drop("n"), "grouped")
    discard(member, tight)
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    m = member2.hint("shuffle_merge")
    texts = d.join(m, d.doc_id.eqNullSafe(m.doc_id) & (d.th == m.th)).select("grp", "sid", "text", "large")
    rows = _shingled(texts.where("NOT large"), size).withColumn("side", F.lit(None).cast("int"))
    out = _verify(rows, ["grp"], percent)
    if member2.where("large").limit(1).count():
        big = stored(_shingled(texts.where("large"), size).dropDuplicates(["grp", "sid"]), "big")
        out = out.unionByName(large_links(big, percent))
    out = stored(out, "links")
    discard(member2)
    return out


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, th, n_shingles and component_id (smallest doc_id reachable by links) of every document."""
    spark = docs.sparkSession
    table = stored(sets(docs, size, percent), "sets")
    tied = stored(ties(docs, size, percent), "ties")
    release(spark)
    found = links(docs, table, tied, size, percent)
    discard(tied)
    release(spark)
    own = stored(table.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("own")), "own")
    # nodes that sort by doc_id, so that the least node of a component bears its least doc_id
    node = F.struct(F.col("own").isNull().alias("none"), "own", "sid")
    edges = found
    for end in ("x", "y"):
        edges = edges.join(own.select(F.col("sid").alias(end), node.alias(f"{end}_node")).hint("shuffle_merge"), end)
    groups = components(edges, "x_node", "y_node").select(F.col("node.sid").alias("sid"), F.col("component.own").alias("least"))
    # written, so that the join with the documents can split a set that a third of them have
    named = stored(own.join(groups.hint("shuffle_merge"), "sid", "left").select("sid", F.coalesce("least", "own").alias("least")), "named")
    slim = table.select("doc_id", "th", "n_shingles", "sid")
    out = slim.join(named.hint("shuffle_merge"), "sid", "left")
    out = stored(out.select("doc_id", "th", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")), "judged")
    discard(table, found, own, named)
    release(spark)
    return out


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without documents whose component has one with a smaller doc_id; of rows that repeat id and text one stays."""
    judged = join(docs, size, percent)
    name = unused(docs, "kept_doc_id")
    keep = judged.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(name)).distinct()
    if judged.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    keep = keep.hint("shuffle_merge")
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep[name]), "left_semi")
