"""Operators on small cases with known answers."""

from __future__ import annotations

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkatlas.operators import bm25, evaluate, fusion, graph, incremental, models, reports, sessions, vectors


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    m = np.repeat(centres, 20, axis=0) + 0.25 * rng.standard_normal((120, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return m, spark.createDataFrame([*rows, (500, None), (501, []), (502, [1.0])], "key long, vec array<double>").repartition(3)


def test_top_k_and_ties(spark, clustered):
    m, df = clustered
    q = df.where("key % 50 = 0 AND key < 120").select(F.col("key").alias("query_id"), "vec")
    got = {(r.query_id, r["rank"]): r.key for r in vectors.top_k(df, q, 5).collect()}
    for i in (0, 50, 100):
        want = sorted(range(120), key=lambda j: (-float(m[i] @ m[j]), j))[:5]
        assert [got[i, r] for r in range(1, 6)] == want
    same = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "key long, vec array<double>")
    one = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vec array<double>")
    assert sorted((r["rank"], r.key) for r in vectors.top_k(same, one, 2).collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("pivots", [1, 7, 40])
def test_similar_pairs_are_exact(clustered, pivots):
    m, df = clustered
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if m[i] @ m[j] >= 0.8}
    clean = df.where("key < 120")
    got = [(r.a, r.b) for r in vectors.similar_pairs(clean, 0.8, pivots=pivots).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_leader_clusters(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)})
    near = {p for p in pairs}
    free, want = set(range(40)), {}
    for i in range(40):
        if i in free:
            own = [j for j in sorted(free) if j > i and (i, j) in near]
            free -= {i, *own}
            if own:
                want[i] = {i, *own}
    got: dict[int, set[int]] = {}
    for r in vectors.leader_clusters(spark.createDataFrame(pairs, "a long, b long")).collect():
        got.setdefault(r.leader, set()).add(r.member)
    assert got == want


def test_bm25_matches_sqlite(spark):
    rng = random.Random(1)
    words = "search searching ranked ranking graphs notes noted linking café running runner data-base models".split()
    docs = [(i, " ".join(rng.choices(words, k=3)), rng.choice(words), " ".join(rng.choices(words, k=rng.randint(3, 30)))) for i in range(1, 40)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, tags, body, tokenize='porter unicode61 remove_diacritics 1')")
    con.executemany("INSERT INTO f(rowid, title, tags, body) VALUES (?, ?, ?, ?)", docs)
    index = bm25.build(spark.createDataFrame(docs, "key long, title string, tags string, body string"))
    texts = {1: "searching", 2: "graph notes", 3: "data-base", 4: "cafe running", 5: "absent", 6: ""}
    got: dict[int, dict[int, float]] = {q: {} for q in texts}
    for r in bm25.search(index, texts).collect():
        got[r.query_id][r.key] = r.score
    for q, t in texts.items():
        match = " ".join(f'"{w}"' for w in t.split())
        want = dict(con.execute("SELECT rowid, bm25(f, 10, 5, 1) FROM f WHERE f MATCH ? ORDER BY 2, 1 LIMIT 30", (match,)).fetchall()) if match else {}
        assert got[q].keys() == want.keys(), t
        assert all(math.isclose(got[q][k], want[k], rel_tol=1e-9) for k in want)


def test_text_searches_ask_the_title_of_every_50th_document(spark):
    from sparkatlas.plans import retrieval

    data = "/root/testdata/sf0.001"
    asked = {r.query_id: r.text for r in retrieval._texts(spark, data).collect()}
    ids = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 50 = 0").collect()}
    assert asked.keys() == ids
    found = {(r.query_id, r.key) for r in retrieval.bm25_topk(spark, data).collect()}
    want = {(r.query_id, r.key) for r in bm25.search(bm25.build(retrieval.A.notes(spark, data)), asked).collect()}
    assert found == want and {q for q, _ in found} == {q for q, t in asked.items() if bm25.parse_query(t)}


def test_feedback_grid_has_all_ten_configurations(spark):
    from sparkatlas.plans import retrieval

    want = {"none", *(f"a={a:g},k={k}" for a in (0.5, 0.7, 0.8, 0.9) for k in (1, 3)), "a=0.9,k=5"}
    got = [r.label for r in retrieval.feedback_grid(spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == 10 and set(got) == want


def test_pagerank(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 1), (2, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    seeds = spark.createDataFrame([(0, 1), (0, 99)], "query_id long, node long")
    got = {r.node: r.score for r in graph.personalised_pagerank(graph.link_graph(df), seeds, graph.degrees(df)).collect()}
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in range(1, 6)}
    score = {n: float(n == 1) for n in near}
    for _ in range(20):
        score = {n: 0.5 * (n == 1) + 0.5 * sum(score[m] / len(near[m]) for m in near[n]) for n in near}
    assert got.keys() == {2, 3, 4, 5} and all(math.isclose(got[n], score[n], rel_tol=1e-9) for n in got)


def test_traversal_keeps_cycles_and_skips_archived(spark):
    e = spark.createDataFrame([("a", "b", "supports", False), ("b", "a", "supports", False), ("b", "c", "extends", True)], "from_path string, to_path string, edge_type string, archived boolean")
    starts = spark.createDataFrame([("a",)], "node string")
    walk = sorted((r.depth, r.from_path, r.to_path) for r in graph.downstream(e, starts, 3).collect())
    assert walk == [(1, "a", "b"), (2, "b", "a"), (3, "a", "b")]
    assert [(r.node, r.depth) for r in graph.symmetric_reach(e, starts).collect()] == [("b", 1)]
    assert sorted((r.supporter, r.dependent) for r in graph.sole_support(e).collect()) == [("a", "b"), ("b", "a"), ("b", "c")]


def test_fusion(spark):
    rows = lambda keys: spark.createDataFrame([(1, k, i) for i, k in enumerate(keys, 1)], "query_id long, key long, rank int")
    got = {r.key: r.score for r in fusion.rrf([rows([7, 8]), rows([8, 9])]).collect()}
    assert got == pytest.approx({7: 1 / 6, 8: 1 / 7 + 1 / 6, 9: 1 / 7})
    assert sorted((r.order, r.key) for r in fusion.seeds(rows([7, 8]), rows([8, 9])).collect()) == [(1, 7), (2, 8), (12, 9)]
    tags = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (3, "x")], "key long, tag string")
    seed = spark.createDataFrame([(1, 1)], "query_id long, key long")
    assert {r.key: r.score for r in fusion.tag_expansion(tags, seed, 10).collect()} == pytest.approx({2: math.log(10 / 3), 3: math.log(10 / 3)})


def test_temporal_rules(spark):
    res = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0)], "query_id long, key long, score double").withColumn("rank", F.lit(1))
    times = spark.createDataFrame([(1, 100.0, 5), (2, 900.0, 6)], "key long, mtime double, session_id long")
    keys = lambda how: sorted(r.key for r in fusion.temporal(res, times, how).collect())
    assert keys(fusion.Temporal(after=500)) == [2, 3]
    assert keys(fusion.Temporal(session_id=5)) == [1]
    aged = {r.key: r.score for r in fusion.temporal(res, times, fusion.Temporal(half_life_days=1, now=100.0 + 86400)).collect()}
    assert aged[1] == pytest.approx(0.5) and aged[3] == 1.0


def test_session_threshold_defaults_without_gaps(spark):
    one = spark.createDataFrame([("u", 1.0, 1)], "user string, sec double, event_id long")
    assert sessions.threshold_minutes(sessions.gaps(one, "user", "sec")).first().threshold == 30


def test_incremental(spark):
    old = spark.createDataFrame([("a", 1.0, "h1"), ("b", 1.0, "h2"), ("c", 1.0, "h3"), ("d", 1.0, "h4"), ("f", 1.0, "h6")], "path string, mtime_ms double, content_hash string")
    new = spark.createDataFrame([("a", 1.5, "zz"), ("b", 9.0, "h2"), ("c", 9.0, "x"), ("e", 1.0, "h5"), ("f", 9.0, None)], "path string, mtime_ms double, content_hash string")
    assert {r.path: r.op for r in incremental.diff(old, new).collect()} == {"a": "unchanged", "b": "mtime", "c": "changed", "d": "deleted", "e": "new", "f": "unparsable"}
    assert {r.path: r.content_hash for r in incremental.upsert(old, new).collect()} == {"a": "h1", "b": "h2", "c": "x", "e": "h5", "f": "h6"}


def test_reports(spark):
    df = spark.createDataFrame([("k", float(x)) for x in range(1, 11)], "key string, v double")
    assert reports.floor_percentiles(df, "key", "v", (50, 90)).first().asDict() == {"key": "k", "p50": 5.0, "p90": 9.0}
    seq = spark.createDataFrame([(i, x) for i, x in enumerate([1, 1, 2, 1, None, None])], "i long, x long")
    assert [r.i for r in reports.drop_consecutive(seq, ["i"], ["x"], F.floor(F.col("i") / 2)).orderBy("i").collect()] == [0, 2, 3, 4]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, key long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 99), (2, 12), (3, 5)], "query_id long, key long")
    r = evaluate.retrieval_metrics(ranked, truth).first()
    assert (r.num_queries, r.recall_at_5, r.mrr, r.hits_at_1) == (3, 0.5, 0.5, round(1 / 3, 6))
    same = evaluate.overlap_and_rho(ranked, ranked).where("query_id = 1").first()
    assert same.rho == 1.0 and same.overlap_5 == pytest.approx(0.4)


def test_models(spark):
    notes = spark.createDataFrame([(1, "graph search"), (2, None)], "key long, body string")
    vecs = {r.key: r.vec for r in models.embed(notes, "body", models.HashingEmbedder(8)).collect()}
    assert len(vecs[1]) == 8 and set(vecs[2]) == {0.0}
    cand = spark.createDataFrame([(1, "graphs", 1, "a graph"), (1, "graphs", 2, "other"), (1, "", 3, "x")], "query_id long, query string, key long, body string")
    assert [(r.key, r.score) for r in models.rerank(cand, models.OverlapScorer()).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]


def test_supersessions_and_edges_are_edited(spark):
    from sparkatlas.operators import incremental

    ddl = "old_pattern_query string, replacement_note_path string, reason string"
    known = spark.createDataFrame([("vector index", "a.md", None)], ddl)
    new = spark.createDataFrame([("  ", "b.md", None), ("the of and", "c.md", None), ("graph walk", "d.md", "r"), (None, "e.md", None)], ddl)
    both = incremental.add_supersessions(known, new)
    assert sorted(r[0] for r in both.collect()) == ["graph walk", "vector index"]
    assert [r[0] for r in incremental.remove_supersessions(both, known).collect()] == ["graph walk"]
    edges = spark.createDataFrame([("a", "b", False), ("a", "c", True), ("c", "a", False), ("b", "c", False)], "from_path string, to_path string, archived boolean")
    nodes = spark.createDataFrame([("a",)], "node string")
    assert sorted(tuple(r)[:2] for r in incremental.remove_edges(edges, nodes).collect()) == [("b", "c")]
    assert sorted(tuple(r)[:2] for r in incremental.remove_edges(edges, nodes, outgoing_only=True).collect()) == [("a", "c"), ("b", "c"), ("c", "a")]


def test_queue_starts_anew_after_a_full_pass(spark):
    from sparkatlas.operators import incremental, lookup

    items = spark.createDataFrame([(f"n{i}",) for i in range(5)], "path string")
    seen = items.where("path < 'n3'")
    rows, over = incremental.next_of_queue(items, seen, most=1)
    assert [r.path for r in rows.collect()] == ["n3"] and not over
    rows, over = incremental.next_of_queue(items, items)
    assert rows.count() == 5 and over
    assert lookup.unvisited_pick(items, items, "path", 3).count() == 3 and lookup.unvisited_pick(items, seen, "path", 3).count() == 2


def test_paths_by_suffix_only(spark):
    from sparkatlas.operators import lookup

    notes = spark.createDataFrame([("a/x.md",), ("b/x.md",), ("b/deep/yx.md",), (None,)], "path string")
    wanted = spark.createDataFrame([(1, "x.md"), (2, "b/x.md"), (3, "none.md"), (4, "p/yx.md")], "wanted_id long, name string")
    got = {r.wanted_id: r.path for r in lookup.find_paths(notes, wanted, exact=False).collect()}
    assert got == {1: "a/x.md", 2: "b/x.md", 3: None, 4: "b/deep/yx.md"}


@pytest.mark.parametrize("sparse", [0.0, 6.0])
def test_pagerank_matches_a_plain_loop(spark, sparse, monkeypatch):
    from sparkatlas.operators import graph

    monkeypatch.setattr(graph, "SPARSE", sparse)
    edges = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (6, 5)]
    g = graph.link_graph(spark.createDataFrame(edges, "src long, dst long"))
    deg = graph.degrees(spark.createDataFrame(edges, "src long, dst long"))
    seeds = spark.createDataFrame([(10, 1), (10, 3), (20, 6), (30, 99)], "query_id long, node long")
    got = {(r.query_id, r.node): r.score for r in graph.personalised_pagerank(g, seeds, deg).collect()}
    near, into = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        into[b] = into.get(b, 0) + 1
    for q, own in ((10, [1, 3]), (20, [6])):
        w = {n: 1 / (into.get(n, 0) + 1) for n in own}
        start = {n: x / sum(w.values()) for n, x in w.items()}
        score = dict(start)
        for _ in range(20):
            score = {n: 0.5 * start.get(n, 0) + 0.5 * sum(score.get(m, 0) / len(near[m]) for m in near[n]) for n in near}
        want = {(q, n): s for n, s in score.items() if s > 1e-6 and n not in own}
        assert {k: v for k, v in got.items() if k[0] == q} == pytest.approx(want)
    assert not any(k[0] == 30 for k in got)


def test_walks_match_a_plain_search(spark):
    from sparkatlas.operators import graph

    rows = [("a", "b", False), ("b", "c", False), ("c", "a", False), ("c", "d", True), ("e", "a", False)]
    edges = spark.createDataFrame([(x, y, "t", z) for x, y, z in rows], "from_path string, to_path string, edge_type string, archived boolean")
    starts = spark.createDataFrame([("a",)], "node string")
    got = sorted((r.depth, r.from_path, r.to_path) for r in graph.downstream(edges, starts, 4).collect())
    assert got == [(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "a", "b")]
    assert {r.node: r.depth for r in graph.symmetric_reach(edges, starts).collect()} == {"b": 1, "c": 1, "e": 1}


def test_api_names_resolve(spark):
    from sparkatlas import api

    notes = spark.createDataFrame([("b.md", ["t"]), ("a.md", [])], "path string, tags array<string>")
    assert [r.path for r in api.call("list_notes", notes).collect()] == ["a.md", "b.md"]
    with pytest.raises(ValueError):
        api.call("nothing")
    wanted = {"find_similar", "search_vault", "find_clusters", "get_inlinks", "get_outlinks", "get_tags", "read_note", "submit_link", "submit_voice_flag", "submit_suspect"}
    assert wanted <= set(api.TOOLS)
    queue = spark.createDataFrame([], "id string, task string, target string, reason string, status string, created_at double")
    items = spark.createDataFrame([("a.md", "old"), ("a.md", "old"), ("b.md", None), ("", "x")], "target string, reason string")
    once = api.call("submit_suspect", queue, items, now=5.0)
    again = api.call("submit_suspect", once, items, now=9.0)
    assert sorted((r.task, r.target, r.status, r.created_at) for r in again.collect()) == [("suspect", "a.md", "pending", 5.0), ("suspect", "b.md", "pending", 5.0)]
    assert api.call("submit_voice_flag", once, items, now=9.0).count() == 4
    assert all(map(callable, api.COMMANDS.values())) and len(api.COMMANDS) >= 30


def test_write_checks_and_link_reasons(spark):
    from sparkatlas.operators import health, incremental

    drafts = spark.createDataFrame([("a", ["x", "x"], ["B"]), ("b", ["x"], ["gone", "b"]), ("c", [], [])], "path string, tags array<string>, links array<string>")
    notes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    similar = spark.createDataFrame([("b", 7, 0.9), ("c", 8, 0.5)], "path string, key long, cosine double")
    got = {r.path: (r.verdict, r.reasons) for r in health.write_checks(drafts, notes, similar).collect()}
    assert got == {"a": ("deny", ["duplicate tags"]), "b": ("warn", ["broken links: gone", "similar to 7"]), "c": ("ok", [])}
    links = spark.createDataFrame([("a", "b|alias")], "src string, dst string")
    suggested = spark.createDataFrame([("a", "A"), ("a", "zz"), ("a", "B"), ("a", "c")], "src string, dst string")
    assert {r.dst: r.reason for r in incremental.judged_links(suggested, links, notes).collect()} == {"A": "self", "zz": "missing", "B": "linked", "c": None}
    queue = spark.createDataFrame([(1, "pending"), (2, "pending")], "id long, status string")
    out = incremental.update_queue(queue, queue.where("id = 2").selectExpr("id", "'done' AS status"), spark.createDataFrame([(2, "pending"), (3, "pending")], "id long, status string"))
    assert sorted(map(tuple, out.collect())) == [(1, "pending"), (2, "done"), (3, "pending")]


def test_links_go_to_the_first_folder(spark):
    from sparkatlas.operators import graph

    notes = spark.createDataFrame([("0-inbox/x.md",), ("3-permanent/x.md",), ("9-other/y.md",)], "path string")
    links = spark.createDataFrame([("a.md", "x"), ("a.md", "y")], "path string, target string")
    assert sorted(r.dst for r in graph.resolve_links(links, notes, graph.FOLDERS).collect()) == ["3-permanent/x.md", "9-other/y.md"]
    assert sorted(r.dst for r in graph.resolve_links(links, notes).collect()) == ["0-inbox/x.md", "9-other/y.md"]


def test_intention_counts_and_messages(spark):
    from sparkatlas.operators import health
    from sparkatlas.sources import notes

    body = spark.createDataFrame([("p", "- work — write it\n* home — call\n- work — test it")], "path string, body string")
    items = health.intentions(body)
    assert [tuple(r) for r in health.intention_counts(items).collect()] == [("work", 2), ("home", 1)]
    assert [tuple(r) for r in health.intention_counts(items, "TEST").collect()] == [("work", 1)]
    said = spark.createDataFrame([("plain",), ('"quoted"',), ('[{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]',)], "c string")
    assert [r[0] for r in said.select(notes.message_text(said["c"])).collect()] == ["plain", "quoted", "a\nb"]


def test_reflect_ranks_candidates_again(spark):
    from sparkatlas.operators import bm25, fusion, models

    rows = [(1, "alpha note", "alpha beta gamma"), (2, "beta note", "beta gamma"), (3, "other", "delta"), (4, "alpha again", "alpha beta gamma delta")]
    notes = spark.createDataFrame([(k, f"{k}.md", t, "", b, 0.0, 0) for k, t, b in rows], "key long, path string, title string, tags string, body string, mtime double, session_id long")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.99, 0.1])], "key long, vec array<double>")
    corpus = fusion.Corpus(notes, vecs, bm25.build(notes), spark.createDataFrame([(1, "t"), (2, "t")], "key long, tag string"), spark.createDataFrame([(1, 2)], "src long, dst long"))
    texts = spark.createDataFrame([(9, "alpha beta gamma")], "query_id long, text string")
    found, pairs = fusion.reflect(corpus, texts, spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vec array<double>"), models.OverlapScorer())
    best = found.orderBy("rank").collect()
    assert [r.key for r in best][:2] == [1, 4] and best[0].score == 1.0 and best[0].top_cosine == pytest.approx(1.0)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 4)}


def test_export_tables(spark):
    from sparkatlas.sources import sinks

    notes = spark.createDataFrame([("a.md", "a", ["t"], "Body of a.", 5.0, None), ("p/b.md", "b", [], "First.\n\nSecond.", 6.0, None), ("c.md", "c", [], "Hidden.", 7.0, "private")], "path string, title string, tags array<string>, body string, mtime_ms double, visibility string")
    vecs = spark.createDataFrame([(p, [1.0]) for p in ("a.md", "p/b.md", "c.md")], "path string, vec array<float>")
    links = spark.createDataFrame([("a.md", "b"), ("c.md", "a")], "path string, target string")
    out = incremental.export_tables(notes, vecs, links, [("p/*", "listed")], "m1", 9.0, default="public")
    assert {(r.path, r.tier, r.updated_at) for r in out["notes"].collect()} == {("a.md", "public", 5), ("p/b.md", "listed", 6)}
    assert {r.path: r.body for r in out["contents"].collect()} == {"a.md": "Body of a.", "p/b.md": "First."}
    assert {r.path for r in out["embeddings"].collect()} == {"a.md", "p/b.md"} and [tuple(r) for r in out["links"].collect()] == [("a.md", "b")]
    assert {r.key: r.value for r in out["meta"].collect()} == {"model_id": "m1", "exported_at": "9000"}


def test_edges_go_by_id(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "a", "c")], "id long, from_path string, to_path string")
    assert [r.id for r in incremental.drop_edges(edges, spark.createDataFrame([(2,), (7,)], "id long")).collect()] == [1]


def test_link_stats(spark):
    from sparkatlas.operators import lookup

    notes = spark.createDataFrame([(p,) for p in ("3-permanent/a.md", "3-permanent/b.md", "3-permanent/sub/c.md", "5-maps/m.md", "5-maps/n.md", "top.md")], "path string")
    links = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "sub/c"), ("x", "b[1]"), ("x", "top")], "path string, target string")
    got = {(r["kind"], r["name"]): (r.n, r.zero_inlinks, r.ratio) for r in lookup.link_stats(notes, links).collect()}
    assert got == {("folder", "3-permanent"): (3, 1, None), ("folder", "5-maps"): (2, 2, None), ("folder", "top.md"): (1, 0, None), ("total", "notes"): (6, None, None), ("total", "links"): (4, None, None), ("ratio", "permanent to maps"): (None, None, 1.5)}
    assert sorted(r.path for r in lookup.without_inlinks(notes, links).collect()) == ["3-permanent/b.md", "5-maps/m.md", "5-maps/n.md"]
    tags = spark.createDataFrame([(1, ["A", "b", "b"]), (2, ["a"]), (3, ["a", "b"])], "key long, tags array<string>")
    assert [tuple(r) for r in lookup.tag_counts(tags, 2).collect()] == [("a", 3), ("b", 2)]


def test_equal_sums_of_ranks_go_by_key(spark):
    """1/6 + 1/30 and 1/10 + 1/10 are equal, their doubles are not."""
    lists = [spark.createDataFrame([(1, 7, a), (1, 3, b)], "query_id long, key long, rank int") for a, b in ((1, 5), (25, 5))]
    assert 1 / 6 + 1 / 30 != 1 / 10 + 1 / 10
    for one in (lists, [x.withColumn("key", 10 - F.col("key")) for x in lists]):
        assert [(r.key, r["rank"]) for r in fusion.rrf(one, digits=12).orderBy("rank").collect()] == [(3, 1), (7, 2)]


def test_equal_vectors_have_equal_scores(spark):
    """Wherever they lie in a matrix: ties go by key, and a task holds few scores."""
    rng = np.random.default_rng(0)
    v = rng.standard_normal(33).tolist()
    df = spark.createDataFrame([(i, v) for i in range(1000)], "key long, vec array<double>").repartition(3)
    q = spark.createDataFrame([(i, rng.standard_normal(33).tolist()) for i in range(300)], "query_id long, vec array<double>")
    for r in vectors.top_k(df, q, 5).groupBy("query_id").agg(F.collect_set("key").alias("keys"), F.count_distinct("score").alias("n")).collect():
        assert sorted(r["keys"]) == [0, 1, 2, 3, 4] and r.n == 1
    best = vectors.Best(np.arange(5000), rng.standard_normal((5000, 8)), 3)
    for i in range(4):
        best.add(np.arange(i * 9000, i * 9000 + 9000), rng.standard_normal((9000, 8)))
    assert len(best) == 15000 and max(len(at) for at, _, _ in best.kept) * vectors.ROWS <= 3 * vectors.SCORES


def test_relevance_by_label_is_that_of_the_pairs(spark):
    rng = random.Random(3)
    keys = spark.createDataFrame([(i, rng.choice([0, 1, 1, None]) if i else 9) for i in range(60)], "key long, label int")
    own = keys.where("key % 4 = 0").select(F.col("key").alias("query_id"), "label")
    ranked = spark.createDataFrame([(q, k, r) for q in range(0, 60, 4) for r, k in enumerate(rng.sample(range(60), 12), 1)], "query_id long, key long, rank int")
    pairs = own.join(keys, "label").where("key <> query_id").select("query_id", "key")
    labels = evaluate.Labels(own, keys)
    assert evaluate.retrieval_metrics(ranked, labels).collect() == evaluate.retrieval_metrics(ranked, pairs).collect()
    assert sorted(labels.sizes().collect()) == sorted(pairs.groupBy("query_id").agg(F.count("*").alias("n")).collect())


@pytest.fixture(params=[None, 5])
def many_blocks(request, spark, monkeypatch):
    """Vectors of which a block holds few, most of them equal."""
    monkeypatch.setattr(vectors, "HOME_NUMBERS", 64 * 12)
    monkeypatch.setattr(vectors, "LEAST_HOMES", 1)
    rng = np.random.default_rng(8)
    m = rng.standard_normal((700, 12))
    m[100:400] = m[100]
    df = vectors.unit(spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(m)), (900, None), (901, [])], "key long, vec array<double>"))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, df.repartition(3), request.param


def test_blocks_bound_a_cell_of_equal_vectors(spark, many_blocks):
    m, df, pivots = many_blocks
    s = m @ m.T
    tags = {i: [f"t{i % 3}", f"u{i % 5}", "u0"] for i in range(650)}
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if s[i, j] >= 0.6}
    got = [(r.a, r.b) for r in vectors.similar_pairs(df, 0.6, pivots=pivots).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    shared = {(i, j): len({*tags[i]} & {*tags[j]}) for i, j in want if i < 650 and j < 650}
    found = vectors.similar_pairs(df, 0.6, pivots=pivots, tags=spark.createDataFrame(list(tags.items()), "key long, tags array<string>"), least=2)
    assert {(r.a, r.b): r.shared for r in found.collect()} == {p: n for p, n in shared.items() if n >= 2}
    largest = vectors._tiles(df, 0.6, pivots, 7).where("home").groupBy("block").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * 64


def test_nearest_are_the_first_of_all_pairs(spark, many_blocks):
    m, df, pivots = many_blocks
    got: dict[int, list[int]] = {}
    for r in vectors.nearest(df, 0.5, 4, pivots=pivots).orderBy("note", "n").collect():
        got.setdefault(r.note, []).append(r.other)
    s = np.array([np.add.accumulate(m * v, axis=1)[:, -1] for v in m])
    for i in range(700):
        want = sorted((j for j in range(700) if j != i and s[i, j] >= 0.5), key=lambda j: (-s[i, j], j))[:4]
        assert got.get(i, []) == want
