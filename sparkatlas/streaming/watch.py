"""Watching a folder of notes: changes are indexed once they have settled, and peers are synced at intervals."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkatlas.operators.note_index import NoteIndex

POLL = "500 milliseconds"
QUIET = 2.0
SYNC_EVERY = 300.0


def fingerprint(spark: SparkSession, root: str) -> tuple[int, int]:
    """Number of the notes below root and a sum over hashes of their paths and times; no note is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("pathGlobFilter", "*.md").load(root)
    # 32 bits of each hash, so that the sum does not overflow
    marks = F.xxhash64("path", "modificationTime").bitwiseAND(F.lit(0xFFFFFFFF))
    found = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(marks), F.lit(0)).alias("mark")).first()
    return found.n, found.mark


def reindex(spark: SparkSession, root: str, index: str) -> dict[str, int]:
    """Bring the kept index up to the folder: only changed files are opened, and only their buckets written."""
    return NoteIndex.at(spark, index).update(root)[1]


@dataclass
class Watcher:
    """What a watch knows between polls: a change waits until nothing has changed for ``quiet`` seconds."""

    look: Callable[[], tuple[int, int]]
    index: Callable[[], object]
    sync: Callable[[], object] | None = None
    quiet: float = QUIET
    sync_every: float = SYNC_EVERY
    seen: tuple[int, int] | None = None
    changed_at: float | None = None
    synced_at: float | None = None

    def poll(self, now: float) -> list[str]:
        """Look once; returns what was done ('index', 'sync'). The first poll sees every note as a change."""
        done = []
        if (mark := self.look()) != self.seen:
            self.seen, self.changed_at = mark, now
        if self.changed_at is not None and now - self.changed_at >= self.quiet:
            self.index()
            self.changed_at = None
            done.append("index")
        if self.sync is not None and (self.synced_at is None or now - self.synced_at >= self.sync_every):
            self.sync()
            self.synced_at = now
            done.append("sync")
        return done


def watch(spark: SparkSession, root: str, index: str, state: str, sync: Callable[[], object] | None = None, poll: str = POLL) -> StreamingQuery:
    """Poll the folder until the query is stopped; a restart looks at the whole folder again, and unchanged notes stay."""
    watcher = Watcher(lambda: fingerprint(spark, root), lambda: reindex(spark, root, index), sync)
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda _, n: watcher.poll(time.monotonic())).option("checkpointLocation", state).trigger(processingTime=poll).start()
