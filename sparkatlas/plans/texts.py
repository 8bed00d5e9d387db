"""Queries of text functions, change detection and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkatlas.functions import text as T
from sparkatlas.operators import incremental
from sparkatlas.plans import adapters as A
from sparkatlas.plans.registry import query, table

HEX_TOKEN = r'token = "[0-9a-f]{40}"'


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 32) AS hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("secret_scrub", "SELECT doc_id, md5(regexp_replace(text, 'token = \"[0-9a-f]{40}\"', '[REDACTED]', 'g')) AS scrubbed, regexp_matches(text, 'token = \"[0-9a-f]{40}\"') AS had_secret FROM documents")
def secret_scrub(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(T.scrub_secrets(t, (HEX_TOKEN, *T.SECRET_PATTERNS))).alias("scrubbed"), t.rlike(HEX_TOKEN).alias("had_secret"))


@query("title_body_parse", f"WITH {A.NOTES_SQL} SELECT key, replace(regexp_replace(split_part(path, '/', 2), '\\.md$', ''), '-', ' ') AS name, split_part(path, '/', 1) AS folder, length(trim(body)) AS n_body FROM notes")
def title_body_parse(spark, d):
    n = A.notes(spark, d)
    return n.select("key", T.title_from_path(F.col("path")).alias("name"), T.top_folder(F.col("path")).alias("folder"), F.length(F.trim("body")).cast("long").alias("n_body"))


@query(
    "summarize_listed",
    f"""WITH {A.NOTES_SQL}, p AS (SELECT key, trim(split_part(trim(body), chr(10) || chr(10), 1)) AS f FROM notes)
SELECT key, CASE WHEN length(f) <= 300 THEN f ELSE regexp_replace(substr(f, 1, 300), '(?s) [^ ]*$', '') || '...' END AS summary FROM p""",
)
def summarize_listed(spark, d):
    return A.notes(spark, d).select("key", T.summarize(F.col("body")).alias("summary"))


RULES = [("src1*/**", "public"), ("src2/**", "listed"), ("**/1*.md", "listed")]


@query(
    "visibility_tier",
    f"""WITH {A.NOTES_SQL} SELECT key, CASE WHEN regexp_matches(path, '^(.*/)?1.*\\.md$') THEN 'listed' WHEN regexp_matches(path, '^src2/.*$') THEN 'listed' WHEN regexp_matches(path, '^src1.*/.*$') THEN 'public' ELSE 'private' END AS tier FROM notes""",
)
def visibility_tier(spark, d):
    return A.notes(spark, d).select("key", T.visibility(F.col("path"), F.lit(None).cast("string"), RULES).alias("tier"))


_ALL_NUMBERS = " || ".join("regexp_extract_all(text, '" + p.replace("'", "''") + "', 1)" for p in T.NUMBER_PATTERNS)


@query("number_claims", f"WITH t AS (SELECT doc_id, text || ' n = ' || doc_id || ', p < 0.05, ' || (doc_id % 40) || ' weeks' AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_distinct({_ALL_NUMBERS}))::INT AS n_numbers FROM t")
def number_claims(spark, d):
    """Numbers of each text with a claim of its own at the end."""
    text = F.concat("text", F.lit(" n = "), "doc_id", F.lit(", p < 0.05, "), F.col("doc_id") % 40, F.lit(" weeks"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(T.numbers(text)).alias("n_numbers"))


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(
    "supersession_match",
    rf"""WITH i AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^A-Za-z0-9_\s-]', ' ', 'g')), '\s+'), lambda w: w <> '' AND w NOT IN ({STOP_SQL}))) AS t FROM benchmark),
w AS (SELECT item_id, unnest(t) AS w FROM i), f AS (SELECT item_id, least(4, len(t)) AS n, unnest(list_sort(t)[1:4]) AS w FROM i),
p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared, any_value(a.n) AS n FROM f a JOIN w b USING (w) WHERE a.item_id <> b.item_id GROUP BY 1, 2)
SELECT a, b, shared, round(shared / n, 6) AS ratio FROM p WHERE shared >= CASE WHEN n = 1 THEN 1 ELSE 2 END AND shared / n >= 0.5""",
)
def supersession_match(spark, d):
    """Four words of weight of each item as patterns, the other items as queries."""
    i = table(spark, d, "benchmark").select("item_id", T.pattern_tokens(F.col("text")).alias("t"))
    words, first = i.select("item_id", F.explode("t").alias("w")), i.select("item_id", F.slice(F.array_sort("t"), 1, 4).alias("t"))
    w = first.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    pairs = w.select(F.col("item_id").alias("a"), "n", "w").join(words.select(F.col("item_id").alias("b"), "w"), "w").where("a <> b")
    p = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    ok = (F.col("shared") >= F.when(F.col("n") == 1, 1).otherwise(2)) & (F.col("shared") / F.col("n") >= 0.5)
    return p.where(ok).select("a", "b", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("ratio"))


def _snapshots(spark, d):
    n = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", (F.col("doc_id") * 1000.0).alias("mtime_ms"), T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    old = n.where("doc_id % 7 <> 0")
    moved = F.when(F.col("doc_id") % 3 == 0, F.col("mtime_ms") + 5).otherwise(F.col("mtime_ms"))
    hashed = F.when(F.col("doc_id") % 6 == 0, F.lit("x")).when(F.col("doc_id") % 15 == 3, F.lit(None).cast("string")).otherwise(F.col("content_hash"))
    new = n.where("doc_id % 11 <> 0").select("path", moved.alias("mtime_ms"), hashed.alias("content_hash"))
    return old.drop("doc_id"), new


@query(
    "incremental_diff",
    """WITH n AS (SELECT doc_id, doc_id::VARCHAR AS path, doc_id * 1000.0 AS m, substr(sha256(coalesce(text, '')), 1, 32) AS h FROM documents),
o AS (SELECT path, m, h FROM n WHERE doc_id % 7 <> 0),
w AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN m + 5 ELSE m END AS m, CASE WHEN doc_id % 6 = 0 THEN 'x' WHEN doc_id % 15 = 3 THEN NULL ELSE h END AS h, TRUE AS now FROM n WHERE doc_id % 11 <> 0)
SELECT coalesce(o.path, w.path) AS path, CASE WHEN now IS NULL THEN 'deleted' WHEN o.path IS NOT NULL AND abs(w.m - o.m) < 1 THEN 'unchanged' WHEN w.h IS NULL THEN 'unparsable' WHEN o.path IS NULL THEN 'new' WHEN w.h = o.h THEN 'mtime' ELSE 'changed' END AS op
FROM o FULL JOIN w ON o.path = w.path""",
)
def incremental_diff(spark, d):
    return incremental.diff(*_snapshots(spark, d))


@query("index_gap", "SELECT (SELECT count(*) FROM labels) AS note_count, (SELECT count(DISTINCT doc_id) FROM documents) AS file_count, (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing")
def index_gap(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"))
    return incremental.index_status(files, table(spark, d, "labels").select(F.col("doc_id").alias("path")))


STUDY_TEXT = "coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' a double-blind trial with n = ' || doc_id || ' adults' WHEN 1 THEN ' prospective study of 12 patients' WHEN 2 THEN ' in vitro' WHEN 3 THEN ' mice and children' ELSE '' END"


@query(
    "study_type",
    f"""WITH t AS (SELECT doc_id, lower({STUDY_TEXT}) AS text FROM documents)
SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{name}'" for name, p in T.STUDY_TYPES)} ELSE 'unknown' END AS kind,
       CASE WHEN regexp_matches(text, '{T.HUMAN}') THEN CASE WHEN regexp_matches(text, '{T.RODENT}') THEN 'human+animal' ELSE 'human' END WHEN regexp_matches(text, '{T.RODENT}') THEN 'animal'
            WHEN regexp_matches(text, '{T.CELLS}') THEN 'in-vitro' WHEN regexp_matches(text, '{T.ANIMAL}') THEN 'animal' ELSE 'unknown' END AS species,
       coalesce(try_cast(nullif(regexp_extract(text, '{T.SAMPLE[0]}', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(text, '{T.SAMPLE[1]}', 1), '') AS BIGINT)) AS n FROM t""",
)
def study_type(spark, d):
    """Design, species and sample of each text, to some of which words that tell them are added."""
    text = F.expr(STUDY_TEXT)
    return table(spark, d, "documents").select("doc_id", T.study_type(text).alias("kind"), T.species(text).alias("species"), T.sample_size(text).alias("n"))


@query("path_class", "SELECT p_type AS folder, CASE p_size % 4 WHEN 0 THEN 'inbox' WHEN 1 THEN 'literature' WHEN 2 THEN 'permanent' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1, 2")
def path_class(spark, d):
    top = F.when(F.col("p_size") % 4 == 0, "Inbox").when(F.col("p_size") % 4 == 1, "02-literature").when(F.col("p_size") % 4 == 2, "permanent").otherwise("attic")
    n = table(spark, d, "part").select(F.col("p_type").alias("folder"), T.classify_folder(F.concat(top, F.lit("/a/"), F.col("p_name"), F.lit(".md"))).alias("kind"))
    return n.groupBy("folder", "kind").agg(F.count("*").alias("n"))


@query("duplicate_tags", "SELECT source AS folder, CASE WHEN lang = 't' || (doc_id % 3) OR doc_id % 3 = doc_id % 5 THEN 'deny' ELSE 'ok' END AS verdict, count(*) AS n FROM documents GROUP BY 1, 2")
def duplicate_tags(spark, d):
    tags = F.array("lang", F.concat(F.lit("t"), F.col("doc_id") % 3), F.concat(F.lit("t"), F.col("doc_id") % 5))
    verdict = F.when(F.size(tags) > F.size(F.array_distinct(tags)), "deny").otherwise("ok")
    return table(spark, d, "documents").select(F.col("source").alias("folder"), verdict.alias("verdict")).groupBy("folder", "verdict").agg(F.count("*").alias("n"))


@query("sentence_delta", r"SELECT doc_id, len(regexp_extract_all(text, '[.!?]+(?:\s|$)'))::INT AS n_sentences FROM documents WHERE text IS NOT NULL")
def sentence_delta(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.n_sentences(F.col("text")).alias("n_sentences"))
