"""The index of a folder of notes, change by change."""

from __future__ import annotations

import os

import pytest

from sparkatlas.operators import models
from sparkatlas.operators import note_index as NI


class Counting(models.HashingEmbedder):
    """Writes each text that it embeds to a file of the test."""

    def __init__(self, log):
        super().__init__(8)
        self.log = str(log)

    def embed(self, texts, query=False):
        with open(self.log, "a") as f:
            f.writelines(t.split("\n")[0] + "\n" for t in texts)
        return super().embed(texts, query)


def parts(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def state(index):
    s = index.store
    return (
        {r.path: (r.title, r.tags) for r in s.read("notes").collect()},
        {r.path: r.body for r in s.read("contents").collect()},
        {(r.path, r.target) for r in s.read("links").collect()},
        {r.path for r in s.read("embeddings").collect()},
    )


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    return Counting(tmp_path_factory.mktemp("model") / "log")


def test_changes(spark, tmp_path, model, monkeypatch):
    folder, root = tmp_path / "notes", tmp_path / "index"
    folder.mkdir()
    for i in range(12):
        (folder / f"n-{i}.md").write_text(f"---\ntags: [t{i % 3}, all]\n---\nBody {i} about harbours [[n-{i + 1}]].")
    (folder / "blank.md").write_text("---\na: b\n---\n")
    index, done = NI.NoteIndex.at(spark, str(root), model).update(str(folder))
    assert done == {"new": 12}
    notes, bodies, links, vecs = state(index)
    assert notes["n-4.md"] == ("n 4", ["t1", "all"]) and bodies["n-4.md"] == "Body 4 about harbours n-5." and ("n-4.md", "n-5") in links and len(vecs) == 12
    assert index.text.search({0: "harbour"}).count() == 12
    assert index.update(str(folder)) == (index, {})

    opened = []
    monkeypatch.setattr(NI.N, "read_files", lambda s, paths, r, real=NI.N.read_files: opened.extend(paths) or real(s, paths, r))
    before, asked, old = parts(root), open(model.log).read().count("\n"), index
    (folder / "n-4.md").write_text("A mountain instead [[n-9]] and [[n-10]].")
    after, done = index.update(str(folder))
    assert done == {"changed": 1} and len(opened) == 1 and opened[0].endswith("n-4.md")
    assert open(model.log).read().count("\n") == asked + 1
    new = parts(root) - before
    assert all(len([p for p in new if f"/{t}/bucket=" in p]) == 1 for t in ("notes", "contents", "links", "embeddings", "lengths"))
    notes, bodies, links, vecs = state(after)
    assert bodies["n-4.md"] == "A mountain instead n-9 and n-10." and {t for p, t in links if p == "n-4.md"} == {"n-9", "n-10"} and len(notes) == len(bodies) == len(vecs) == 12
    assert {r.key for r in after.text.search({0: "mountains"}).collect()} == {"n-4.md"} and after.text.search({0: "harbour"}).count() == 11
    # a reader of the commit before sees all tables as they were
    assert state(old)[1]["n-4.md"] == "Body 4 about harbours n-5." and old.text.search({0: "mountains"}).count() == 0

    os.utime(folder / "n-5.md", (1, 1))
    (folder / "n-6.md").unlink()
    (folder / "n-7.md").write_text("---\nonly: front\n---\n")
    (folder / "x.md").write_text("new one")
    asked = open(model.log).read().count("\n")
    last, done = after.update(str(folder))
    assert done == {"mtime": 1, "deleted": 1, "unparsable": 1, "new": 1}
    assert open(model.log).read().count("\n") == asked + 1
    notes, bodies, links, vecs = state(last)
    assert "n-6.md" not in notes and bodies["n-7.md"].startswith("Body 7") and set(notes) == set(bodies) == vecs == {f"n-{i}.md" for i in range(12) if i != 6} | {"x.md"}
    assert {r.path: r.mtime_ms for r in last.store.read("notes").collect()}["n-5.md"] == 1000
    assert {r.key for r in last.text.search({0: "Body"}, 50).collect()} == set(notes) - {"x.md", "n-4.md"}
    opened.clear()
    assert last.update(str(folder)) == (last, {}) and not opened  # the note that can't be read is not opened again
    (folder / "blank.md").write_text("no longer blank")
    (folder / "void.md").write_text("---\nc: d\n---\n")
    more, done = last.update(str(folder))
    assert done == {"new": 1} and len(opened) == 2 and state(more)[1]["blank.md"] == "no longer blank"
    (folder / "void.md").unlink()
    less, done = more.update(str(folder))
    assert done == {} and [r.path for r in less.store.read("blanks").collect()] == ["n-7.md"]
    whole = NI.NoteIndex(less.store.compact(0), model)
    assert state(whole) == state(less) and not whole.store.manifest.voids


def test_a_model_of_another_width(spark):
    class Wrong(models.HashingEmbedder):
        def embed(self, texts, query=False):
            return [[0.0] * 3 for _ in texts]

    with pytest.raises(Exception, match="64 numbers"):
        models.embed(spark.createDataFrame([(1, "a")], "key long, t string"), "t", Wrong(64)).collect()
