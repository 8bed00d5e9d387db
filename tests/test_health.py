"""Note health, gates and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkatlas.operators import health


def test_citation_issues(spark):
    rows = [
        (("Smith et al.", 2020, "pmid", ["John Smith", "Ann Lee"], 2020), []),
        (("Lee & Park", 2019, "pmid", ["John Smith", "Ann Lee"], 2020), ["author_not_first", "year_off_by_one"]),
        (("Lee", 2019, "doi", ["J. Smith", "A. Lee"], 2020), ["author_not_first"]),
        (("Doe", 2010, "doi", ["Smith"], 2020), ["wrong_author", "wrong_year"]),
        (("O'Brien", 2020, "doi", ["OBRIEN KM"], 2020), []),
        (("X Doe", 2000, "doi", None, None), ["not_found"]),
        (("Doe", 2000, "doi", [], 2000), ["unverifiable_author"]),
        ((None, None, "doi", ["Smith"], 2000), []),
        (("", 2001, "pmid", ["Smith"], 2000), ["year_off_by_one"]),
    ]
    df = spark.createDataFrame([r for r, _ in rows], "author string, year int, kind string, authors array<string>, found int")
    got = [[i.issue for i in r.x] for r in df.select(health.citation_issues(*[F.col(c) for c in df.columns]).alias("x")).collect()]
    assert got == [want for _, want in rows]


def test_cascade_and_inverted_index(spark):
    recs = spark.createDataFrame([(1, "b", 7, "Ann", ["Ann"]), (1, "a", 8, "Ann", ["Bob"]), (1, "c", 9, "Ann", ["Anne"])], "query_id int, service string, record_id int, author string, authors array<string>")
    assert [r.record_id for r in health.resolve_cascade(recs, ["a", "b", "c"]).collect()] == [7]
    idx = spark.createDataFrame([(1, "the", [0, 2]), (1, "cat", [1]), (1, "hat", [3])], "key int, word string, places array<int>")
    assert health.text_of_index(idx).first().text == "the cat the hat"


def test_inbox_status(spark):
    rows = [("Use this for the harbour.", False, 5, 0, 0.0), ("x", False, 2, 0, 0.0), ("x", False, 0, 3, 1e6), ("x", True, 0, 0, 0.0), (None, None, 0, 3, 0.0), ("First. It is RELEVANT TO boats! Last.", False, 0, 0, 0.0)]
    got = health.inbox_status(spark.createDataFrame(rows, "body string, declared boolean, inlinks int, outlinks int, mtime double"), 1e6).collect()
    assert [r.status for r in got] == ["intentioned", "resolved", "resolved", "resolved", "limbo", "intentioned"]
    assert [got[0].intention, got[5].intention] == ["Use this for the harbour", "It is RELEVANT TO boats"]


def test_promote_gate(spark):
    # depth, sourcing, linking, voice, atomicity, integrity, synthesis, requested -> destination, rewrite, warned
    cases = [
        ((1, 1, 1, 1, 1, 1, 0, None), ("3-permanent", False, False)),
        ((1, 1, 1, 0, 1, 1, 0, None), ("3-permanent", True, False)),
        ((1, 1, 1, 1, 1, 0, 0, None), ("1-fleeting", False, False)),
        ((1, 1, 0, 1, 1, 1, 0, None), ("1-fleeting", False, False)),
        ((1, 0, 0, 1, 0, 1, 0, None), ("1-fleeting", False, False)),
        ((0, 0, 0, 1, 0, 1, 0, None), ("0-inbox", False, False)),
        ((1, 0, 1, 1, 1, 0, 1, None), ("3-permanent", False, False)),
        ((1, 0, 1, 0, 1, 0, 1, None), ("3-permanent", True, False)),
        ((1, 0, 0, 1, 0, 0, 1, None), ("0-inbox", False, False)),
        ((0, 0, 0, 0, 0, 0, 0, "2-literature"), ("2-literature", False, False)),
        ((0, 0, 0, 1, 0, 1, 0, "3-permanent"), ("0-inbox", False, True)),
        ((1, 1, 1, 1, 1, 1, 0, "0-inbox"), ("3-permanent", False, False)),
    ]
    kind = ", ".join(f"{c} boolean" for c in health.CRITERIA) + ", synthesis boolean, requested string"
    df = spark.createDataFrame([tuple(bool(x) for x in c[:7]) + (c[7],) for c, _ in cases], kind).coalesce(1)
    assert [(r.destination, r.rewrite, r.warning is not None) for r in health.promote_gate(df).collect()] == [want for _, want in cases]


def test_stale_and_skipped(spark):
    texts = {"deprecated since 2021, took 30 fps": True, "price 3.5 for 2 users": False, "V1.2 needs 5 GB": True, "in 2019": False, "12 items": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(health.stale(F.lit(90), F.col("t"))).collect()] == list(texts.values())
    assert not df.select(F.max(health.stale(F.lit(59), F.col("t")))).first()[0]
    prompts = {"Try again!!!": True, "what is the harbour made of?": False, "nineteen letters!!!!!!": True, "<command> that is long enough": True, None: True, "   continue   ": True}
    df = spark.createDataFrame([(p,) for p in prompts], "p string")
    assert [r[0] for r in df.select(health.skipped_prompt(F.col("p"))).collect()] == list(prompts.values())


def test_intentions(spark):
    items = spark.createDataFrame([("p", "- when tired — rest\n- no dash\n* at desk — write")], "path string, body string")
    assert sorted((r.context, r.cue) for r in health.intentions(items).collect()) == [("at desk", "write"), ("when tired", "rest")]
