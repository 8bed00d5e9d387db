"""Windows that occur more than once in a corpus: routing them to where they can be compared.

Every window of ``length`` symbols (words or bytes) is dealt to one trigger, its
gram of least rolling hash, so equal windows have equal triggers at equal
places. Only triggers travel: about one for every ten words, or forty bytes. A
trigger's context is what its windows cover. Sorted by trigger and context,
three cases show:

* the trigger occurs once: none of its windows repeats;
* its context occurs again, whole: all of its windows repeat (with ``verify``
  two places of it are sent as well, and the comparison has to agree);
* the trigger has other contexts too: one copy of each context is sent, by
  trigger, to a shard, where the contexts are compared symbol by symbol.

No key gathers in one task. Triggers that fill a large part of the table are
salted by document: each part judges its own rows and sends one copy of each of
its contexts, so that the shard compares across parts. A trigger with more than
``common`` contexts (a boundary of a very common passage) goes window by window
instead: windows are counted by 128 bits of hash, summed before the shuffle.

A document is known by doc_id and a hash of its text; rows that repeat both
share one verdict.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm import textcore
from sparkatlas.llm.common import beside, discard, release, stored, unused
from sparkatlas.llm.textcore import slices

SLICE_BYTES = 2 << 20
KEY = "doc_id long, th long"
TRIGGERS = f"{KEY}, lo int, n int, trigger long, context long, part int"
CONTEXTS = f"{KEY}, lo int, n int, trigger long, context long, copies long, sent boolean"
SEGMENTS = f"{KEY}, route long, more long, copies long, lo int, body binary, common boolean"
SPANS = f"{KEY}, s int, e int"
#: Parts of a salted trigger.
SALT = 256
#: Marks rows that report frequent triggers.
REPORT = -1
#: Marks, as the start of a span, a context (trigger, context instead of doc_id, th) whose copies differ.
REFUTED = -1
#: Copies of a row that is sent as the second place of its context.
SECOND = 0


@dataclass(frozen=True)
class Unit:
    """What a window counts: words or bytes."""

    name: str
    length: int
    gram: int
    #: Contexts above which a trigger goes window by window.
    common: int
    #: A trigger is salted if slices of text that hold it ``often`` times have more than ``hot`` of it
    #: together, and a thousandth of all that slices report.
    hot: int = 4096
    often: int = 8
    #: Contexts that occur again are sent too, from two places, and are copies only if compare agrees.
    verify: bool = False

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Joined bytes, start and end byte and 64-bit value of each symbol, and where each text's symbols begin."""
        if self.name == "words":
            return textcore.words(texts)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        place = np.arange(len(flat))
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        return flat, place, place + 1, textcore.BYTES[flat], bounds


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def _ints(a: np.ndarray, kind: str = "int32") -> pa.Array:
    return pa.array(a.astype(kind))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def triggers(docs: DataFrame, unit: Unit, passes: int) -> DataFrame:
    """A row for each trigger; with part REPORT, how often (lo) a task saw a trigger that is frequent in a slice."""
    names = ["doc_id", "th", "lo", "n", "trigger", "context", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Counter[int] = Counter()

        def report() -> pa.RecordBatch:
            m = len(frequent)
            none = pa.nulls(m, pa.int64())
            seen = np.minimum(np.fromiter(frequent.values(), np.int64, m), 2**31 - 1)
            hashes = np.fromiter(frequent.keys(), np.uint64, m)
            return pa.RecordBatch.from_arrays([none, none, _ints(seen), _ints(np.zeros(m)), _signed(hashes), none, _ints(np.full(m, REPORT))], names=names)

        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2)
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE_BYTES):
                _, _, _, values, bounds = unit.symbols(texts[a:b])
                gram, lo, count, context = textcore.anchors(values, bounds, unit.length, unit.gram)
                kinds, seen = np.unique(gram, return_counts=True)
                often = seen >= unit.often
                frequent.update(dict(zip(kinds[often].tolist(), seen[often].tolist())))
                if len(frequent) > 200_000:
                    yield report()
                    frequent.clear()
                text = np.searchsorted(bounds, lo, "right") - 1
                pick = pa.array(text + a)
                part = _ints((gram >> np.uint64(8)) % np.uint64(passes))
                yield pa.RecordBatch.from_arrays([ids.take(pick), hashes.take(pick), _ints(lo - bounds[text]), _ints(count), _signed(gram), _signed(context), part], names=names)
        if frequent:
            yield report()

    return keyed(docs).where("text IS NOT NULL").mapInArrow(run, TRIGGERS)


def hot_triggers(found: DataFrame, least: int) -> list[int]:
    """The salted triggers: fewer than a thousand, since each has a thousandth of all that is reported."""
    reports = found.where(F.col("part") == REPORT).groupBy("trigger").agg(F.sum("lo").alias("seen"))
    total = reports.agg(F.sum("seen")).first()[0] or 0
    return [r.trigger for r in reports.where(F.col("seen") > max(least, total // 1000)).collect()]


class Runs:
    """Rows sorted by trigger and context, in batches: spans of copied contexts, and contexts to send.

    Of a context whose rows go on in the next batch only the first row is kept.
    """

    def __init__(self, unit: Unit, keep_first: bool, hot: list[int]):
        self.unit, self.keep_first = unit, keep_first
        self.hot = np.sort(np.array(hot, np.int64))
        self.held: pa.Table | None = None
        self.weight, self.multi = 0, False

    def add(self, table: pa.Table, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            table = pa.concat_tables([self.held, table])
        if not len(table):
            return
        table = table.combine_chunks()
        trigger, context = (table.column(k).to_numpy() for k in ("trigger", "context"))
        size = np.ones(len(trigger), np.int64)
        size[0] = self.weight or 1
        new_trigger = np.concatenate(([True], trigger[1:] != trigger[:-1]))
        new = new_trigger | np.concatenate(([True], context[1:] != context[:-1]))
        first = np.flatnonzero(new)
        copies = np.add.reduceat(size, first)
        group = np.cumsum(new_trigger)[first] - 1
        multi = np.bincount(group)[group] > 1
        multi[group == 0] |= self.multi
        done = len(first) if last else len(first) - 1
        send = (multi | np.isin(trigger[first], self.hot) | (self.unit.verify & (copies > 1)))[:done]
        copied = ~new
        if self.keep_first:  # a row that repeats the first place is no copy
            copied &= ~self._same(table, np.repeat(first, np.diff(np.append(first, len(new)))))
        else:
            copied[first[:done]] = copies[:done] > 1
        yield from self._rows(table, np.flatnonzero(copied), None)
        yield from self._rows(table, first[:done][send], copies[:done][send])
        if self.unit.verify:
            second = first[np.diff(np.append(first, len(new))) > 1] + 1
            if self.weight > 1 and len(second) and second[0] == 1:  # sent with an earlier batch
                second = second[1:]
            yield from self._rows(table, second, np.full(len(second), SECOND))
        if not last:
            self.held, self.weight, self.multi = table.slice(first[-1], 1), int(copies[-1]), bool(multi[-1])

    @staticmethod
    def _same(table: pa.Table, first: np.ndarray) -> np.ndarray:
        out = np.ones(len(first), bool)
        for name in ("doc_id", "th", "lo"):
            column = table.column(name)
            values = column.to_numpy() if not column.null_count else column.fill_null(0).to_numpy()
            out &= values == values[first]
            if column.null_count:
                null = column.is_null().to_numpy()
                out &= null == null[first]
        return out

    @staticmethod
    def _rows(table: pa.Table, rows: np.ndarray, copies: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if len(rows):
            own = table.select(["doc_id", "th", "lo", "n", "trigger", "context"]).take(pa.array(rows)).combine_chunks().to_batches()[0]
            m = len(rows)
            more = [pa.nulls(m, pa.int64()) if copies is None else pa.array(copies), pa.array(np.full(m, copies is not None))]
            yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*own.schema.names, "copies", "sent"])


def contexts(part: DataFrame, unit: Unit, keep_first: bool, hot: list[int]) -> DataFrame:
    """Rows of triggers judged: contexts that are copies (sent is false), and contexts to send with their copies."""
    salted = F.xxhash64("trigger", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALT)))
    key = F.when(F.col("trigger").isin(hot), salted).otherwise(F.col("trigger")) if hot else F.col("trigger")
    order = ["trigger", "context", *(["doc_id", "th", "lo"] if keep_first else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(unit, keep_first, hot)
        for batch in batches:
            yield from runs.add(pa.Table.from_batches([batch]))
        if runs.held is not None:
            yield from runs.add(runs.held.slice(0, 0), last=True)

    rows = part.select("doc_id", "th", "lo", "n", "trigger", "context", key.alias("key")).repartition("key").drop("key")
    return rows.sortWithinPartitions(*order).mapInArrow(run, CONTEXTS)


def segments(docs: DataFrame, sent: DataFrame, unit: Unit) -> DataFrame:
    """The text of each context to be compared, once, with the route to its shard; the hash of each window instead where the trigger is common."""
    many = sent.where(F.col("copies") != SECOND).groupBy("trigger").count().where(F.col("count") > unit.common).select("trigger", F.lit(True).alias("common"))
    rows = sent.join(beside(many), "trigger", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    rows = rows.where(~F.col("common") | (F.col("copies") != SECOND))  # windows are counted from one place each
    own = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("trigger", "copies", "lo", "n", "common", "context")).alias("own"))
    d = keyed(docs)
    own = own.hint("shuffle_merge")
    joined = d.join(own, d.doc_id.eqNullSafe(own.doc_id) & (d.th == own.th)).select(d.doc_id, d.th, "text", "own")
    names = ["doc_id", "th", "route", "more", "copies", "lo", "body", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE_BYTES):
                flat, start, end, values, bounds = unit.symbols(texts[a:b])
                raw = flat.tobytes()
                lists = batch.column(3).slice(a, b - a)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(b - a), sizes)
                trigger, copies, lo, n, common, context = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(6))
                s = lo + bounds[text]
                plain = np.flatnonzero(~common)
                if len(plain):
                    ends = end[s[plain] + n[plain] - 2 + unit.length]
                    bodies = [raw[x:y] for x, y in zip(start[s[plain]].tolist(), ends.tolist())]
                    pick = pa.array(text[plain] + a)
                    yield pa.RecordBatch.from_arrays([ids.take(pick), hashes.take(pick), pa.array(trigger[plain]), pa.array(context[plain]), pa.array(copies[plain]), _ints(lo[plain]), pa.array(bodies, pa.binary()), pa.array(np.zeros(len(plain), bool))], names=names)
                if len(plain) < len(common):
                    own = np.flatnonzero(common)
                    row = np.repeat(own, n[own])
                    step = np.arange(len(row)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                    w = s[row] + step
                    one, two = (textcore.Spans(v)(w, w + unit.length) for v in (values, textcore.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
                    pick = pa.array(text[row] + a)
                    m = len(row)
                    yield pa.RecordBatch.from_arrays([ids.take(pick), hashes.take(pick), _signed(one), _signed(two), pa.array(copies[row]), _ints(lo[row] + step), pa.nulls(m, pa.binary()), pa.array(np.ones(m, bool))], names=names)

    return joined.mapInArrow(run, SEGMENTS)


def common_windows(rows: DataFrame, unit: Unit, keep_first: bool) -> DataFrame:
    """Spans of single windows that occur again (keep_first: at an earlier place)."""
    place = F.struct("doc_id", "th", "lo")
    kept = F.min(place).alias("first") if keep_first else F.lit(None).alias("first")
    again = rows.groupBy("route", "more").agg(F.sum("copies").alias("total"), kept).where("total > 1").drop("total")
    found = rows.join(again, ["route", "more"])
    found = found.where(~place.eqNullSafe(F.col("first"))) if keep_first else found.where("copies = 1")
    return found.select("doc_id", "th", F.col("lo").alias("s"), (F.col("lo") + unit.length).alias("e"))


#: (bodies, place of each body's first symbol as doc number << 32 | symbol) -> per body a mask over its windows.
Compare = Callable[[list[bytes], np.ndarray], list[np.ndarray]]


def compared(sent: DataFrame, unit: Unit, compare: Compare, shard_bytes: int, skip_copied: bool) -> DataFrame:
    """Spans of windows that compare finds repeated, from shards of bounded size (a route has ``common`` contexts at most).

    With verify, also a mark for each context of several copies with a window that compare does not find again.
    """

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        # a second place is one of its own, even where rows repeat both id and text
        of = [(*r[:2], r[3] == SECOND) for r in rows]
        docs = {k: i for i, k in enumerate(sorted(set(of), key=lambda k: (k[0] is not None, k)))}
        place = np.array([docs[k] << 32 | r[4] for k, r in zip(of, rows)], np.int64)
        masks = compare([r[5] for r in rows], place)
        sizes = np.fromiter(map(len, masks), np.int64, len(masks))
        # all masks in one, each followed by a False, so that one difference finds every span
        at = np.cumsum(sizes + 1) - sizes
        row = np.repeat(np.arange(len(rows)), sizes)
        flat = np.zeros(int(sizes.sum()) + len(rows) + 1, np.int8)
        flat[np.arange(len(row)) + row + 1] = np.concatenate(masks)
        edge = np.flatnonzero(np.diff(flat))
        first, last = edge[0::2] + 1, edge[1::2] + 1
        row = np.searchsorted(at, first, "right") - 1
        if skip_copied:
            single = np.array([r[3] for r in rows])[row] == 1
            first, last, row = first[single], last[single], row[single]
        base = np.array([r[4] for r in rows], np.int64)[row] - at[row]
        pick = row.tolist()
        wrong = [r for r, m in zip(rows, masks) if r[3] > 1 and not m.all()] if unit.verify else []
        none = np.full(len(wrong), REFUTED)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in pick] + [r[2] for r in wrong], pa.int64()),
                pa.array([rows[i][1] for i in pick] + [r[6] for r in wrong], pa.int64()),
                _ints(np.concatenate((base + first, none))),
                _ints(np.concatenate((base + last - 1 + unit.length, none))),
            ],
            names=["doc_id", "th", "s", "e"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if size > shard_bytes and rows and rows[-1][2] != r[2]:
                    yield judge(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
        if rows:
            yield judge(rows)

    slim = sent.select("doc_id", "th", "route", "copies", "lo", "body", "more")
    return slim.repartition("route").sortWithinPartitions("route").mapInArrow(run, SPANS)


def _packed(s: Column, e: Column) -> Column:
    return F.shiftleft(s.cast("long"), 32) + e


def repeated_spans(docs: DataFrame, unit: Unit, compare: Compare, shard_bytes: int, keep_first: bool, passes: int = 2) -> DataFrame:
    """doc_id, th and the list of spans (first symbol << 32 | end) that repeated windows cover.

    keep_first: the first place of a window (by doc_id, then hash of the text,
    then place) does not count as repeated.
    """
    found = stored(triggers(docs, unit, passes), "triggers", by="part")
    hot = hot_triggers(found, unit.hot)
    judged = []
    for i in range(passes):  # in passes over ranges of the hash, so that little is on disk at once
        part = found.where(F.col("part") == i)
        judged.append(stored(contexts(part, unit, keep_first, hot), "contexts", by="sent"))
        release(docs.sparkSession)
    discard(found)
    every = judged[0]
    for other in judged[1:]:
        every = every.unionByName(other)
    body = stored(segments(docs, every.where("sent"), unit), "segments", by="common")
    release(docs.sparkSession)
    whole = every.where("NOT sent")
    mixed = compared(body.where("NOT common"), unit, compare, shard_bytes, skip_copied=not keep_first)
    if unit.verify:
        mixed = verdicts = stored(mixed, "verdicts")
        refuted = verdicts.where(F.col("s") == REFUTED).select(F.col("doc_id").alias("trigger"), F.col("th").alias("context")).distinct()
        whole = whole.join(beside(refuted), ["trigger", "context"], "left_anti")
        mixed = mixed.where(F.col("s") != REFUTED)
    whole = whole.select("doc_id", "th", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + unit.length).alias("e"))
    spans = whole.unionByName(mixed).unionByName(common_windows(body.where("common"), unit, keep_first))
    out = stored(spans.groupBy("doc_id", "th").agg(F.collect_list(_packed(F.col("s"), F.col("e"))).alias("spans")), "spans")
    discard(*judged, body, *([verdicts] if unit.verify else []))
    release(docs.sparkSession)
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of docs with all of its columns and, last, its spans (null where it has none)."""
    i, t, s = (unused(docs, name) for name in ("spans_doc_id", "spans_th", "spans"))
    known = spans.select(F.col("doc_id").alias(i), F.col("th").alias(t), F.col("spans").alias(s)).hint("shuffle_merge")
    same = docs["doc_id"].eqNullSafe(known[i]) & (F.xxhash64(docs["text"]) == known[t])
    return docs.join(known, same, "left").drop(i, t)


def covered(sizes: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Mask, flat over texts of these sizes, of what their lists of spans cover."""
    base = np.cumsum(sizes) - sizes
    counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(base, counts)
    total = int(sizes.sum())
    step = np.bincount(at + (flat >> 32), minlength=total + 1) - np.bincount(at + (flat & 0xFFFFFFFF), minlength=total + 1)
    return np.cumsum(step[:total]) > 0
