"""Streams of events: sessions, repeated targets, windows, incremental indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, schema: str = EVENTS, lateness: str = "10 minutes") -> DataFrame:
    """A file stream of events with a watermark on their time."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def sessions(stream: DataFrame, gap_minutes: int) -> DataFrame:
    """Sessions per user that end after a gap (learned from the log beforehand)."""
    w = F.session_window("ts", f"{gap_minutes} minutes")
    return stream.groupBy("user_id", w).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


#: Groups that keys are dealt to: one state each, however many keys there are.
TTL_GROUPS = 1 << 10


def dedupe_ttl(stream: DataFrame, keys: list[str], out: list[str], seconds: float = 180) -> DataFrame:
    """The columns ``out`` of events whose keys did not pass within so many seconds before.

    Keys are dealt to groups by a hash. A group's state holds the times at which
    its keys last passed; each goes once the watermark is past its use.
    """
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in out)
    # as texts: whole numbers beside nulls would become doubles
    names = [f"_key{i}" for i in range(len(keys))]
    held = ", ".join(f"{c} array<string>" for c in names)
    ttl = int(seconds * 1e6)

    def check(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        old = state.get if state.exists else [[] for _ in (*names, "last")]
        new = list(batches)
        pdf = pd.concat(new) if new else pd.DataFrame({c: [] for c in dict.fromkeys(["ts", *names, *out])})
        if len(pdf):
            pdf = pdf.sort_values(["ts", *out], kind="stable")
        rows = [*zip(*old[:-1])] + [*zip(*(pdf[c].tolist() for c in names))]
        rows = [tuple(None if x is None or x != x else x for x in row) for row in rows]
        last = dict(zip(rows, old[-1]))
        keep = []
        for row, t in zip(rows[len(old[-1]) :], (pdf["ts"].astype("int64") // 1000).tolist() if len(pdf) else []):
            before = last.get(row)
            keep.append(before is None or t - before >= ttl)
            if keep[-1]:
                last[row] = t
        if len(pdf):
            yield pdf.loc[np.array(keep, bool), out]
        last = {row: t for row, t in last.items() if t + ttl > mark}
        if not last:
            if state.exists:
                state.remove()
            return
        state.update((*(list(c) for c in zip(*last)), list(last.values())))
        state.setTimeoutTimestamp(max(int(max(last.values()) // 1000 + seconds * 1000), state.getCurrentWatermarkMs() + 1))

    dealt = stream.select("*", *[F.col(c).cast("string").alias(n) for c, n in zip(keys, names)]).withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(TTL_GROUPS)).cast("int"))
    return dealt.groupBy("_group").applyInPandasWithState(check, schema, f"{held}, last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(stream: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and kind of event."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Process all that is there and stop; output and state go to shared folders."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def index_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], state: str, every: str | None = None) -> StreamingQuery:
    """Hand each batch of changed notes to an indexer; every: a processing interval, else what is there now."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", state)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
