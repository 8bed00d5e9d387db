"""Readers, writers and streams over small folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkatlas.sources import notes, sinks
from sparkatlas.operators.note_index import NoteIndex
from sparkatlas.streaming import convergence, logs, watch


def test_scan_and_parse(spark, tmp_path):
    files = {"a/x-y.md": "---\ntags: [t1]\nvisibility: listed\n---\nHello [[B]].", "_skip/n.md": "no", ".hid/n.md": "no", "top.md": "kept", "empty.md": "---\na: b\n---\n", "d/p.excalidraw.md": "# Drawing\n```json\n" + json.dumps({"elements": [{"type": "text", "text": "One"}, {"type": "text", "text": "Gone", "isDeleted": True}, {"type": "line"}]}) + "\n```"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r for r in notes.parse_notes(notes.scan_markdown(spark, str(tmp_path))).collect()}
    assert set(got) == {"a/x-y.md", "top.md", "d/p.excalidraw.md"}
    x = got["a/x-y.md"]
    assert (x.title, x.tags, x.links, x.body, x.visibility) == ("x y", ["t1"], ["b"], "Hello B.", "listed")
    assert got["d/p.excalidraw.md"].body == "One" and len(x.content_hash) == 32


def test_logs_drop_malformed_lines(spark, tmp_path):
    (tmp_path / "events-2024-01.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "action": "write"}\nnot json\n{"ts": "2024-01-02T00:00:00Z", "action": "read"}\n')
    assert sorted(r.action for r in notes.read_log(spark, str(tmp_path), "events-", "ts string, action string").collect()) == ["read", "write"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_snapshot(spark.range(3), root)
    sinks.write_snapshot(spark.range(5), root)
    assert sinks.read_snapshot(spark, root).count() == 5


def test_episodes(spark):
    lines = spark.createDataFrame([(1, "1. [proj, 2024-01-02] - 87% match"), (2, '   "a snippet"'), (3, "noise")], "n int, line string")
    assert [tuple(r) for r in notes.episodes(lines).collect()] == [("proj", "2024-01-02", 0.87, "a snippet")]


def test_ttl_dedupe_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{m:02d}:00", 1, "a") for i, m in enumerate([0, 2, 3, 5, 9])]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("").alias("props")).write.parquet(str(tmp_path / "in"))
    stream = logs.dedupe_ttl(logs.events_stream(spark, str(tmp_path / "in")), ["user_id", "event_type"], ["event_id"])
    logs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.event_id for r in spark.read.schema("event_id long").parquet(str(tmp_path / "out")).collect()) == [0, 2, 4]


def test_convergence_stream(spark, tmp_path):
    first = "We asked Ada Lovelace about engines and looms. The method of Smith (2001) measures rainfall over mountains."
    other = "Glaciers retreat quickly whenever summers grow warmer. Whales near Grace Hopper sing along coastal trenches, says Jones 1999."
    rows = [("s", f"2024-01-01 00:00:0{i}", q, r) for i, (q, r) in enumerate([("alpha", first), ("Alpha two", other), ("beta", first), ("ALPHA", first)])]
    rows += [("t", f"2024-01-01 00:00:{i:02d}", f"q{i:02d}", None) for i in range(14)]
    kind = "session string, t string, query string, result string"
    spark.createDataFrame(rows, kind).select("session", F.col("t").cast("timestamp").alias("ts"), "query", "result").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, ts timestamp, query string, result string").parquet(str(tmp_path / "in"))
    logs.run_available(convergence.converge(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.schema(convergence.OUTPUT).parquet(str(tmp_path / "out")).orderBy("session", "n").collect()
    got = [r for r in out if r.session == "s"]
    assert [(r.cycle, r.novelty, r.n_citations, r.novel_citations, r.reason) for r in got] == [
        ("none", 1.0, 1, 1, "continue"),
        ("substring", 1.0, 1, 1, "continue"),
        ("none", 0.0, 1, 0, "hard_stop:semantic_cycle_no_novelty"),
        ("exact", 0.0, 1, 0, "hard_stop:query_and_semantic_cycle"),
    ]
    assert [r.mean for r in got] == [None, None, 1.0, 0.7] and got[0].novel_entities >= 1 and got[2].novel_entities == 0
    empty = [r for r in out if r.session == "t"]
    assert [r.reason for r in empty] == ["continue"] * 11 + ["hard_stop:budget_exhausted"] * 3 and {(r.n_sentences, r.novelty, r.cosine) for r in empty} == {(0, 1.0, 0.0)}


def test_sessions_are_forgotten(spark, tmp_path):
    kind = "session string, t string, query string, result string"

    def put(session, hour):
        spark.createDataFrame([(session, f"2024-01-01 {hour:02d}:00:00", "first", "Some words of a result.")], kind).select("session", F.col("t").cast("timestamp").alias("ts"), "query", "result").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("session string, ts timestamp, query string, result string").parquet(str(tmp_path / "in"))
        q = convergence.converge(stream, kept_hours=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    assert put("s", 1) == 1
    assert put("u", 9) == 1  # the watermark is past what s could still use
    put("s", 9)
    got = {(r.session, r.n, r.cycle) for r in spark.read.schema(convergence.OUTPUT).parquet(str(tmp_path / "out")).collect()}
    assert got == {("s", 1, "none"), ("u", 1, "none")}


@pytest.mark.parametrize(
    "args, reason",
    [((3, "none", False, 0.04, 0.05), "soft_stop:saturation"), ((3, "none", False, 0.09, 0.5), "soft_stop:diminishing_returns"), ((3, "none", False, 0.2, 0.5), "continue"), ((2, "none", False, 0.0, None), "continue"), ((12, "exact", False, 1.0, 1.0), "hard_stop:budget_exhausted")],
)
def test_verdicts(args, reason):
    assert convergence.verdict(*args) == (reason != "continue", reason)


def test_changes_settle_before_they_are_indexed():
    marks = iter([(1, 1), (1, 1), (2, 9), (2, 8), (2, 8), (2, 8), (2, 8), (1, 3), (1, 3)])
    done = []
    watcher = watch.Watcher(lambda: next(marks), lambda: done.append("index"), lambda: done.append("sync"), quiet=2, sync_every=5)
    assert [watcher.poll(t) for t in (0, 1, 2, 3, 4, 5, 6, 7, 9)] == [["sync"], [], [], [], [], ["index", "sync"], [], [], ["index"]]
    assert done == ["sync", "index", "sync", "index"]


def test_watched_folder(spark, tmp_path):
    import time

    folder, index = tmp_path / "notes", str(tmp_path / "index")
    folder.mkdir()
    (folder / "a.md").write_text("first")
    (folder / "b.md").write_text("second")
    (folder / "c.txt").write_text("no note")
    query = watch.watch(spark, str(folder), index, str(tmp_path / "state"))

    def settle(want):
        until = time.monotonic() + 60
        while time.monotonic() < until and query.isActive:
            if {r.path: r.body for r in NoteIndex.at(spark, index).store.read("contents").collect()} == want:
                return True
            time.sleep(0.5)
        return False

    try:
        assert settle({"a.md": "first", "b.md": "second"})
        (folder / "a.md").unlink()
        (folder / "b.md").write_text("changed, and longer")
        (folder / "d.md").write_text("new")
        assert settle({"b.md": "changed, and longer", "d.md": "new"})
    finally:
        query.stop()
