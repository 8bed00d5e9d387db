"""Steps whose tasks stay bounded however large the input is."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sparkatlas.operators import graph, lookup, storage
from sparkatlas.streaming import logs


def test_links_are_told_apart_in_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    edges = [(a, b) for a in range(30) for b in range(20, 40)] * 2 + [(None, 1), (1, None)]
    found = graph.link_graph(spark.createDataFrame(edges, "src long, dst long"))
    want = {(a, b) for a, b in edges if a is not None and b is not None and a != b}
    want |= {(b, a) for a, b in want}
    assert found.rdd.getNumPartitions() > 50 and found.count() == len(want)
    assert {tuple(r) for r in found.collect()} == want


def test_sole_support_in_as_many_tasks_as_it_needs(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    edges = [(a, b) for b in range(200) for a in range(b % 3 + 1)] * 2
    found = graph.sole_support(spark.createDataFrame(edges, "from_path long, to_path long"))
    assert found.rdd.getNumPartitions() > 30
    assert sorted(r.dependent for r in found.collect()) == list(range(0, 200, 3))


def test_sample_sorts_only_rows_below_a_bound(spark):
    rows = spark.range(60000).select(F.when(F.col("id") % 2 == 0, "even").when(F.col("id") > 59990, "few").alias("s"), (F.col("id") % 50000).alias("k"))
    found = lookup.stratified_sample(rows, "s", "k", 20, seed=7, once=True)
    strata: dict = {}
    for r in set(map(tuple, rows.collect())):
        strata.setdefault(r[0], []).append((hashlib.md5(f"7:{r[1]}".encode()).hexdigest(), r[1]))
    want = {(s, k, i) for s, own in strata.items() for i, (_, k) in enumerate(sorted(own)[:20], 1)}
    assert {tuple(r) for r in found.collect()} == want and len(want) == 45
    # with repeated rows
    twice = {(r.s, r.pick): r.k for r in lookup.stratified_sample(rows.unionByName(rows), "s", "k", 20, seed=7).collect()}
    assert all(twice[s, 1] == twice[s, 2] == min(own)[1] for s, own in strata.items())


def test_ttl_state_is_one_for_many_keys(spark, tmp_path):
    """5,000 users in as many groups as there are, not in a state each; nulls are a key, later files see what passed."""
    start = 1_700_000_000

    def put(rows, name):
        df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string")
        df = df.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(0.0).alias("value"), F.lit("").alias("props"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    first = [(u, start, u, "a") for u in range(5000)] + [(10_000, start + 5, 7, "b"), (10_001, start, None, "a"), (10_002, start + 9, None, "a")]
    put(first, "1")
    stream = lambda: logs.dedupe_ttl(logs.events_stream(spark, str(tmp_path / "in")), ["user_id", "event_type"], ["event_id"])
    logs.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    put([(20_000, start + 100, 7, "a"), (20_001, start + 180, 8, "a"), (20_002, start + 181, None, "a"), (20_003, start + 359, 8, "a")], "2")
    q = stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {*range(5000), 10_000, 10_001, 20_001, 20_002}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= logs.TTL_GROUPS


def test_dense_pagerank_moves_scores_by_hubs(spark, monkeypatch):
    """Equal to a plain loop, with hubs broadcast or not; each edge lies once, with its end of smaller degree."""
    edges = [(a, 100 + b) for a in range(40) for b in range(10) if (a * 7 + b * 3) % 11] + [(100, 101), (0, 1)]
    links = spark.createDataFrame(edges, "src long, dst long")
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seeds = {q: [100 + q % 10, q] for q in range(40)}
    want = {}
    into = {n: sum(b == n for _, b in edges) for n in near}
    for q, own in seeds.items():
        w = {n: 1 / (into[n] + 1) for n in own}
        score = back = {n: w.get(n, 0.0) / sum(w.values()) for n in near}
        for _ in range(4):
            score = {n: 0.5 * back[n] + 0.5 * sum(score[m] / len(near[m]) for m in near[n]) for n in near}
        want |= {(q, n): s for n, s in score.items() if n not in own and s > 1e-6}
    kept = []
    bucketed = graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda df, column, label: kept.append((df.count(), column)) or bucketed(df, column, label))
    asked = spark.createDataFrame([(q, n) for q, own in seeds.items() for n in own], "query_id long, node long")
    for most in (1 << 17, 0):
        monkeypatch.setattr(graph, "HUBS", most)
        found = graph.personalised_pagerank(graph.link_graph(links), asked, graph.degrees(links), rounds=4, top=100)
        got = {(r.query_id, r.node): r.score for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert kept == [(len(edges), "o")] * 2
