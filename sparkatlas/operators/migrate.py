"""Moving embeddings to another model: a shadow table that survives a stop, swapped in whole.

The shadow lies beside the index and is filled bucket by bucket; each batch of
buckets is a commit, so a run that was stopped goes on after the last one.
Notes that changed meanwhile are embedded again before the swap. The old
vectors stay where they are until ``drop_old``, and a reader sees one model or
the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.functions import text as T
from sparkatlas.operators import models
from sparkatlas.operators.note_index import NoteIndex
from sparkatlas.sources.store import Store, Table

#: Buckets that are embedded between two commits.
BATCH = 4
MARKS = Table("part int, seen long, model string", "part")


def _shadow(index: NoteIndex, label: str) -> Store:
    tables = {"embeddings": index.store.tables["embeddings"], "marks": MARKS}
    return Store(index.store.spark, f"{index.store.root}/shadow-{label}", tables, index.store.buckets)


def _texts(index: NoteIndex, rows: DataFrame) -> DataFrame:
    """(key, embed_text) of notes' contents (path, body)."""
    notes = index.store.read("notes").select("path", "title", "tags")
    return rows.join(notes, "path").select(F.col("path").alias("key"), T.embedding_text(F.col("title"), F.col("body"), F.col("tags")).alias("embed_text"))


def migrate(index: NoteIndex, model: models.Embedder, label: str, batch: int = BATCH, after: Callable[[int], None] | None = None) -> NoteIndex:
    """The index with embeddings of another model. label names the shadow; after is told how many buckets are done at each commit."""
    store, shadow = index.store, _shadow(index, label)
    done = {r.part for r in shadow.read("marks").collect()}
    left = [b for b in range(store.buckets) if b not in done]
    for first in range(0, len(left), batch):
        own = left[first : first + batch]
        vecs = models.embed(_texts(index, store.read("contents", own)), "embed_text", model, key="string")
        marks = store.spark.createDataFrame([(b, store.manifest.version, label) for b in own], MARKS.schema)
        shadow = shadow.commit({"embeddings": vecs.withColumnRenamed("key", "path"), "marks": marks})
        if after is not None:
            after(len(done) + first + len(own))
    # what a bucket did not hold when it was embedded
    marks = shadow.read("marks").groupBy("part").agg(F.max("seen").alias("seen"))
    contents = store.read("contents", version=True).withColumn("part", store.bucket_of(F.col("path")))
    late = contents.join(F.broadcast(marks), "part").where("version > seen").select("path", "body")
    gone = shadow.read("embeddings").select("path").join(contents.select("path"), "path", "left_anti")
    if late.limit(1).count() or gone.limit(1).count():
        vecs = models.embed(_texts(index, late), "embed_text", model, key="string").withColumnRenamed("key", "path")
        again = store.spark.createDataFrame([(b, store.manifest.version, label) for b in range(store.buckets)], MARKS.schema)
        shadow = shadow.commit({"embeddings": vecs, "marks": again}, {"embeddings": late.select("path").unionByName(gone)})
    return NoteIndex(store.swap("embeddings", shadow, f"shadow-{label}"), model)


def drop_old(index: NoteIndex) -> list[str]:
    """Delete what only older snapshots read, old vectors among it."""
    return index.store.vacuum(1)
