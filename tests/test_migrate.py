"""Embeddings moved to another model, with a stop in between and notes that change meanwhile."""

from __future__ import annotations

import pytest

from sparkatlas.operators import migrate, models
from sparkatlas.operators.note_index import NoteIndex


class Counting(models.HashingEmbedder):
    def __init__(self, log, width):
        super().__init__(width)
        self.log = str(log)

    def embed(self, texts, query=False):
        with open(self.log, "a") as f:
            f.write("x" * len(texts))
        return super().embed(texts, query)


def vectors(index):
    return {r.path: len(r.vec) for r in index.store.read("embeddings").collect()}


def test_stop_go_on_and_swap(spark, tmp_path):
    folder, log = tmp_path / "notes", tmp_path / "log"
    folder.mkdir()
    for i in range(30):
        (folder / f"n{i}.md").write_text(f"Body {i} about harbours.")
    old, _ = NoteIndex.at(spark, str(tmp_path / "index"), models.HashingEmbedder(8), buckets=6).update(str(folder))
    model = Counting(log, 16)

    def stop(buckets):
        if buckets >= 4:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        migrate.migrate(old, model, "m2", batch=2, after=stop)
    before = len(log.read_text())
    assert 0 < before < 30 and set(vectors(NoteIndex.at(spark, str(tmp_path / "index"))).values()) == {8}

    # a note of each kind of change between the stop and the second run
    (folder / "n3.md").write_text("Mountains instead")
    (folder / "n4.md").unlink()
    (folder / "new.md").write_text("a new one")
    now, done = NoteIndex.at(spark, str(tmp_path / "index"), models.HashingEmbedder(8), buckets=6).update(str(folder))
    assert done == {"changed": 1, "new": 1, "deleted": 1}
    moved = migrate.migrate(now, model, "m2", batch=2)
    assert len(log.read_text()) <= 30 + 2  # what was embedded before the stop was not embedded again
    names = {f"n{i}.md" for i in range(30) if i != 4} | {"new.md"}
    assert vectors(moved) == dict.fromkeys(names, 16)
    fresh = models.HashingEmbedder(16)
    for path, text in (("n3.md", "Title: n3\n\nMountains instead"), ("n9.md", "Title: n9\n\nBody 9 about harbours.")):
        got = next(r.vec for r in moved.store.read("embeddings").where(f"path = '{path}'").collect())
        assert got == pytest.approx(fresh.embed([text])[0])
    # a reader of the snapshot before, and the text index, are as they were
    assert set(vectors(now).values()) == {8} and moved.text.search({0: "harbour"}, 50).count() == 28
    # later changes go into the moved table
    (folder / "n5.md").write_text("Rivers")
    later, _ = NoteIndex(moved.store, model).update(str(folder))
    assert vectors(later) == vectors(moved)
    assert migrate.drop_old(later) and vectors(NoteIndex.at(spark, str(tmp_path / "index"), model, buckets=6)) == vectors(later)
