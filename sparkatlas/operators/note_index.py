"""The index of a tree of notes: notes, contents, links, embeddings and full text, changed together.

All tables live in one store, so a change of one note writes one bucket of each
and readers see every table before or after it. A listing of paths and times
decides which files are opened; what a changed file's hash then says decides
what is written: a new time only, or the whole note.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.operators import bm25, models
from sparkatlas.operators.incremental import diff
from sparkatlas.operators.kept_text import KeptText, tables
from sparkatlas.operators.storage import held, written
from sparkatlas.sources import notes as N
from sparkatlas.sources.store import Store, Table

TABLES = tables("string") | {
    "notes": Table("path string, title string, tags array<string>, mtime_ms double, content_hash string, visibility string", "path", "path"),
    "contents": Table("path string, body string", "path", "path"),
    "links": Table("path string, target string", "path", "path"),
    "embeddings": Table("path string, vec array<float>", "path", "path"),
    "blanks": Table("path string, mtime_ms double", "path", "path"),  # files that held no note when they were opened
}
#: Changed files that are opened by name at most; beyond, the whole tree is scanned once.
BY_NAME = 1 << 10
#: Parts of a bucket beyond which it is rewritten.
PARTS = 8


@dataclass(frozen=True)
class NoteIndex:
    """A snapshot of the index; take_in returns the next one."""

    store: Store
    model: models.Embedder

    @staticmethod
    def at(spark: SparkSession, root: str, model: models.Embedder | None = None, buckets: int = 16) -> NoteIndex:
        return NoteIndex(Store(spark, root, TABLES, buckets), model or models.HashingEmbedder(64))

    @property
    def text(self) -> KeptText:
        return KeptText(self.store, bm25.Fields(), "string")

    def take_in(self, listing: DataFrame, open_files: Callable[[DataFrame], DataFrame]) -> tuple[NoteIndex, dict[str, int]]:
        """Bring the index up to listing (path, full_path, mtime_ms); open_files reads rows of it (adds raw).

        Returns how many notes were new, changed, touched only (mtime), deleted or unparsable; these stay as they were.
        """
        old, blanks = self.store.read("notes"), self.store.read("blanks")
        was = old.select("path", F.col("mtime_ms").alias("_was"))
        known = was.unionByName(blanks.select("path", F.col("mtime_ms").alias("_was"))).withColumnRenamed("path", "_path")
        same = (F.col("path") == F.col("_path")) & (F.abs(F.col("mtime_ms") - F.col("_was")) < 1)
        doubtful = written(listing.join(known, same, "left_anti"), "doubtful-notes")
        found = written(N.parse_notes(open_files(doubtful)), "opened-notes")
        gone = held(was.join(listing.select("path"), "path", "left_anti").select("path"), "gone-notes")
        now = doubtful.select("path", "mtime_ms").join(found.select("path", "content_hash"), "path", "left")
        ops = diff(old.select("path", "mtime_ms", "content_hash").join(doubtful.select("path"), "path", "left_semi"), now)
        # a file without a note that the index never had is no note at all
        ops = held(ops.join(was.select("path", F.lit(True).alias("_had")), "path", "left").where("op <> 'unparsable' OR _had").drop("_had"), "note-changes")
        done = {r.op: r.n for r in ops.groupBy("op").agg(F.count("*").alias("n")).collect()} | {"deleted": gone.count()}
        done = {k: n for k, n in done.items() if n}
        empty = held(doubtful.select("path", "mtime_ms").join(found.select("path"), "path", "left_anti"), "blank-notes")
        left = held(blanks.select("path").join(listing.select("path"), "path", "left_anti"), "gone-blanks")
        no_note = {"blanks": empty}, {"blanks": doubtful.select("path").unionByName(left)} if self.store.manifest.parts else {}
        if not set(done) - {"unparsable", "unchanged"}:
            if not empty.count() and not left.count():
                return self, done
            return NoteIndex(self.store.commit(*no_note), self.model), done
        whole = found.join(ops.where("op IN ('new', 'changed')").select("path"), "path", "left_semi")
        times = old.drop("mtime_ms").join(ops.where("op = 'mtime'").select("path"), "path", "left_semi").join(doubtful.select("path", "mtime_ms"), "path")
        columns = ["path", "title", "tags", "mtime_ms", "content_hash", "visibility"]
        changed = whole.select("path").unionByName(gone)
        vecs = models.embed(whole.select(F.col("path").alias("key"), "embed_text"), "embed_text", self.model, key="string")
        rows, void = self.text.changes(whole.select(F.col("path").alias("key"), "title", F.array_join("tags", " ").alias("tags"), "body"), gone.select(F.col("path").alias("key")))
        rows |= {
            "notes": whole.select(*columns).unionByName(times.select(*columns)),
            "contents": whole.select("path", "body"),
            "links": whole.select("path", F.explode("links").alias("target")),
            "embeddings": vecs.withColumnRenamed("key", "path"),
        }
        if self.store.manifest.parts:
            void |= {"notes": changed.unionByName(times.select("path"))} | {t: changed for t in ("contents", "links", "embeddings")}
        store = self.store.commit(rows | no_note[0], void | no_note[1])
        return NoteIndex(store.compact(PARTS), self.model), done

    def update(self, root: str) -> tuple[NoteIndex, dict[str, int]]:
        """Bring the index up to a folder of notes; only files whose time has changed are opened."""
        spark = self.store.spark

        def open_files(wanted: DataFrame) -> DataFrame:
            paths = [r.full_path for r in wanted.select("full_path").limit(BY_NAME + 1).collect()]
            if not paths:
                return wanted.withColumn("raw", F.lit(None).cast("string")).where("false")
            if len(paths) > BY_NAME:
                return N.scan_markdown(spark, root).join(wanted.select("path"), "path", "left_semi")
            return N.read_files(spark, paths, root)

        return self.take_in(N.list_markdown(spark, root), open_files)
