"""Queries of the state of notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkatlas.operators import health
from sparkatlas.plans import adapters as A
from sparkatlas.plans.registry import query, table

REFS_SQL = "refs AS (SELECT conv_id AS name, count(DISTINCT turn) AS n FROM conversations GROUP BY 1)"


@query(
    "fleeting_sweep",
    f"""WITH {A.NOTES_SQL}, {REFS_SQL}, j AS (SELECT path, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 2 THEN 'PROMOTED' WHEN key % 2 = 0 AND coalesce(n, 0) = 0 AND key * 86400.0 >= 5184000 THEN 'STALE' END AS status FROM notes LEFT JOIN refs ON name = key WHERE key % 9 <> 0)
SELECT path, n, status FROM j WHERE status IS NOT NULL""",
)
def fleeting_sweep(spark, d):
    """Turns of a conversation seen as the notes that refer to the note of its number; notes are a day apart."""
    n = A.notes(spark, d).select("path", F.col("key").alias("name"), (F.lit(A.NOW) - F.col("key") * health.DAY).alias("mtime"), (F.col("key") % 2 == 0).alias("is_project"), (F.col("key") % 9 == 0).alias("is_counterpoint"))
    refs = table(spark, d, "conversations").select(F.col("conv_id").alias("name"), F.col("turn").alias("from_path"))
    return health.fleeting_sweep(n, refs, A.NOW)


FOLDER_SQL = "CASE source WHEN 'src0' THEN 'inbox' WHEN 'src1' THEN 'fleeting' ELSE source END"


def folder():
    """The first two sources seen as inbox and fleeting notes."""
    return F.when(F.col("source") == "src0", "inbox").when(F.col("source") == "src1", "fleeting").otherwise(F.col("source"))


@query("investigation_route", f"SELECT {FOLDER_SQL} AS folder, CASE WHEN l.doc_id IS NULL THEN 'link_check' WHEN source IN ('src0', 'src1') THEN 'voice_gate' ELSE 'none' END AS route, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ALL")
def investigation_route(spark, d):
    linked = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("inlinks"))
    docs = table(spark, d, "documents").select("doc_id", folder().alias("folder")).join(linked, "doc_id", "left").na.fill(0, ["inlinks"])
    return docs.groupBy("folder", health.route(F.col("inlinks"), F.col("folder")).alias("route")).agg(F.count("*").alias("n"))


@query(
    "claim_tier",
    f"""WITH {A.LOG_SQL}, s AS (SELECT user_id, round(avg((k % 3 + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END) / 4), 6) AS score FROM log GROUP BY user_id)
SELECT user_id, score, CASE WHEN score < 0.4 THEN 'shallow' WHEN score <= 0.7 THEN 'medium' ELSE 'deep' END AS tier FROM s""",
)
def claim_tier(spark, d):
    k = F.col("k")
    return health.claim_tier(A.log(spark, d).select("user_id", (k % 3).alias("specificity"), F.when(k % 2 == 0, 2).otherwise(0).alias("grounded")), "user_id")


@query(
    "memory_decay",
    f"""WITH {A.LOG_SQL}, s AS (SELECT event_id // 500 AS n, k AS file FROM log), m AS (SELECT file, (SELECT max(n) FROM s) - max(n) AS absent FROM s WHERE n <= file % 25 GROUP BY file)
SELECT file, absent, CASE WHEN absent >= 15 THEN 'medium' WHEN absent >= 10 THEN 'weak' ELSE 'fresh' END AS strength FROM m""",
)
def memory_decay(spark, d):
    """Snapshots of 500 events; a file is no longer retrieved after the snapshot of its number."""
    seen = A.log(spark, d).select(F.floor(F.col("event_id") / 500).cast("long").alias("n"), F.col("k").alias("file"))
    return health.memory_decay(seen.select("n").distinct(), seen.where(F.col("n") <= F.col("file") % 25), weak=10, medium=15)


PROMPT_SQL = "CASE WHEN turn % 6 = 5 THEN 'Try again!!' WHEN turn % 6 = 4 THEN '<note>' || text ELSE text END"
SKIP_SQL = "(length(regexp_replace(trim(prompt), '[.!?,:;]+$', '')) < 20 OR regexp_matches(regexp_replace(trim(prompt), '[.!?,:;]+$', ''), '(?i)^(ok|yes|no|thanks|try\\s+again|continue|go|sure|done)$') OR starts_with(trim(prompt), '<'))"


@query(
    "injection_gate",
    f"""WITH p AS (SELECT conv_id, turn, {PROMPT_SQL} AS prompt, unnest([length(text) % 70 / 100.0, (conv_id * 7 + turn * 13) % 60 / 100.0]) AS score FROM conversations WHERE text IS NOT NULL),
b AS (SELECT conv_id, turn, prompt, max(score) AS best FROM p GROUP BY ALL)
SELECT conv_id, turn, round(best, 6) AS best, {SKIP_SQL} AS skipped, NOT {SKIP_SQL} AND best >= 0.35 AS passed FROM b""",
)
def injection_gate(spark, d):
    """Turns as prompts, some of them stock ones or commands, with the scores of two backends."""
    turns = table(spark, d, "conversations").where("text IS NOT NULL")
    prompt = F.when(F.col("turn") % 6 == 5, "Try again!!").when(F.col("turn") % 6 == 4, F.concat(F.lit("<note>"), "text")).otherwise(F.col("text"))
    scores = F.array(F.length("text") % 70 / 100.0, (F.col("conv_id") * 7 + F.col("turn") * 13) % 60 / 100.0)
    gate = health.injection_gate(turns.select(F.struct("conv_id", "turn").alias("prompt_id"), prompt.alias("prompt"), F.explode(scores).alias("score")))
    return gate.select("prompt_id.conv_id", "prompt_id.turn", F.round("best", 6).alias("best"), "skipped", "passed")


SAID_SQL = "coalesce(text, '') || CASE doc_id % 7 WHEN 0 THEN ' Apply to the harbour plan.' WHEN 1 THEN ' Deprecated, it took 30 fps.' WHEN 2 THEN ' Version v2.1 is out.' WHEN 3 THEN ' In 2021 it was 12 MB.' ELSE '' END"


def said():
    """Texts, with what a note may say of itself at the end of some."""
    k = F.col("doc_id") % 7
    return F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " Apply to the harbour plan.").when(k == 1, " Deprecated, it took 30 fps.").when(k == 2, " Version v2.1 is out.").when(k == 3, " In 2021 it was 12 MB.").otherwise(""))


@query(
    "stale_notes",
    rf"""WITH n AS (SELECT doc_id, doc_id / 10.0 AS age, {SAID_SQL} AS body FROM documents)
SELECT doc_id FROM n WHERE age >= 60 AND regexp_matches(body, '(?i)v\d+\.\d+|\b20\d{{2}}\b|deprecated') AND regexp_matches(body, '(?i)\d+\.?\d*\s*(ms|s|MB|GB|%|fps|req/s|items|notes|tokens)')""",
)
def stale_notes(spark, d):
    """Notes that are old and name a version or a date and a quantity; ten notes a day."""
    docs = table(spark, d, "documents")
    return docs.where(health.stale(F.col("doc_id") / 10.0, said())).select("doc_id")


@query(
    "inbox_statuses",
    f"""WITH l AS (SELECT conv_id AS doc_id, count(*) AS inlinks FROM conversations GROUP BY 1),
n AS (SELECT doc_id, {SAID_SQL} AS body, coalesce(inlinks, 0) AS inlinks, length(coalesce(text, '')) % 6 AS outlinks, doc_id / 50.0 AS age FROM documents LEFT JOIN l USING (doc_id)),
i AS (SELECT *, nullif(trim(regexp_extract(body, '(?i)[^.!?\n]*(?:when working on|when designing|when building|use this for|reference this for|reference for|apply to|relevant to)[^.!?\n]*')), '') AS intention FROM n)
SELECT doc_id, md5(intention) AS intention, CASE WHEN intention IS NOT NULL THEN 'intentioned' WHEN inlinks >= 2 OR (age <= 7 AND outlinks >= 3) THEN 'resolved' ELSE 'limbo' END AS status FROM i""",
)
def inbox_statuses(spark, d):
    """Turns of a conversation as links to the note of its number; fifty notes a day."""
    inlinks = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("inlinks"))
    notes = table(spark, d, "documents").join(inlinks, "doc_id", "left")
    notes = notes.select("doc_id", said().alias("body"), F.coalesce("inlinks", F.lit(0)).alias("inlinks"), (F.length(F.coalesce("text", F.lit(""))) % 6).alias("outlinks"), (F.lit(A.NOW) - F.col("doc_id") / 50.0 * health.DAY).alias("mtime"), F.lit(False).alias("declared"))
    return health.inbox_status(notes, A.NOW).select("doc_id", F.md5("intention").alias("intention"), "status")


PROMOTE_SQL = """WITH f AS (SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l) <> '')) >= 3 AS depth, contains(coalesce(text, ''), 'http') OR length(coalesce(text, '')) % 3 > 0 AS sourcing, contains(coalesce(text, ''), ',') AS linking,
  NOT contains(coalesce(text, ''), '!') AND length(coalesce(text, '')) % 5 > 0 AS voice, length(coalesce(text, '')) < 3000 AS atomicity, coalesce(quality, 1) = 1 AS integrity, lang = 'en' AND doc_id % 4 = 0 AS synthesis,
  CASE doc_id % 11 WHEN 0 THEN '2-literature' WHEN 1 THEN '3-permanent' WHEN 2 THEN '0-inbox' END AS requested FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)),
g AS (SELECT *, sourcing OR synthesis AS s, integrity OR synthesis AS i, depth::INT + linking::INT + voice::INT + atomicity::INT + (sourcing AND NOT synthesis)::INT + (integrity AND NOT synthesis)::INT AS passes FROM f),
h AS (SELECT *, coalesce(requested = '3-permanent', false) AND passes <= 2 AS demoted, coalesce(requested = '2-literature', false) AS lit FROM g),
r AS (SELECT *, CASE WHEN lit THEN '2-literature' WHEN demoted THEN '0-inbox' WHEN depth AND linking AND atomicity AND s AND i THEN '3-permanent' WHEN NOT i OR passes >= 3 THEN '1-fleeting' ELSE '0-inbox' END AS destination FROM h)
SELECT doc_id, passes, destination, destination = '3-permanent' AND NOT voice AS rewrite, demoted AS warned FROM r"""


@query("promote_routes", PROMOTE_SQL)
def promote_routes(spark, d):
    """Where each document would go, by criteria read off its text and its label."""
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    label = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    k = F.col("doc_id") % 11
    notes = table(spark, d, "documents").join(label, "doc_id", "left").select(
        "doc_id",
        (F.size(F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")) >= 3).alias("depth"),
        (F.contains(text, F.lit("http")) | (n % 3 > 0)).alias("sourcing"),
        F.contains(text, F.lit(",")).alias("linking"),
        (~F.contains(text, F.lit("!")) & (n % 5 > 0)).alias("voice"),
        (n < 3000).alias("atomicity"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("integrity"),
        ((F.col("lang") == "en") & (F.col("doc_id") % 4 == 0)).alias("synthesis"),
        F.when(k == 0, "2-literature").when(k == 1, "3-permanent").when(k == 2, "0-inbox").alias("requested"),
    )
    return health.promote_gate(notes).select("doc_id", "passes", "destination", "rewrite", F.col("warning").isNotNull().alias("warned"))


SURNAMES = r"list_transform(list_filter(string_split_regex(lower({0}), '[\s,&]+'), lambda s: length(s) > 1 AND s NOT IN ('et', 'al', 'al.')), lambda s: regexp_replace(s, '[^a-z]', '', 'g'))"
NAMES_MATCH = "len(list_filter(m, lambda w: len(list_filter({0}, lambda x: contains(x, w) OR contains(w, x))) > 0)) > 0"


@query(
    "citation_check",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-zA-Z]{{3,}}') AS w FROM documents), t AS (SELECT doc_id, w FROM w WHERE len(w) >= 6),
c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN w[1] || ' et al.' WHEN 1 THEN w[4] || ' & ' || w[6] WHEN 2 THEN 'Zyzzqx, Q.' WHEN 3 THEN w[1] END AS author, 2000 + doc_id % 4 AS year, CASE WHEN doc_id % 2 = 0 THEN 'pmid' ELSE 'doi' END AS kind,
  CASE doc_id % 13 WHEN 0 THEN NULL WHEN 1 THEN []::VARCHAR[] ELSE [w[2] || ' ' || w[1], w[3] || ', ' || w[4]] END AS authors FROM t),
m AS (SELECT *, {SURNAMES.format('author')} AS m, {SURNAMES.format('authors[1]')} AS a1, {SURNAMES.format('authors[2]')} AS a2 FROM c),
x AS (SELECT *, coalesce({NAMES_MATCH.format('a1')}, false) AS first, coalesce({NAMES_MATCH.format('a2')}, false) AS second FROM m),
issues AS (SELECT doc_id, unnest([CASE WHEN authors IS NULL THEN 'not_found' END, CASE WHEN author IS NOT NULL AND len(authors) = 0 THEN 'unverifiable_author' END, CASE WHEN author IS NOT NULL AND len(authors) > 0 AND NOT (first OR second) THEN 'wrong_author' END,
  CASE WHEN author IS NOT NULL AND second AND NOT first THEN 'author_not_first' END, CASE WHEN abs(year - 2001) > 1 THEN 'wrong_year' END, CASE WHEN abs(year - 2001) = 1 AND kind = 'pmid' THEN 'year_off_by_one' END]) AS issue FROM x)
SELECT doc_id, issue FROM issues WHERE issue IS NOT NULL""",
)
def citation_check(spark, d):
    """Claims made of a document's first words against a record made of them, with authors in another order, missing, wrong or unknown."""
    w = table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([a-zA-Z]{3,})"), 1).alias("w")).where("size(w) >= 6")
    k, at = F.col("doc_id"), lambda i: F.col("w")[i]
    author = F.when(k % 5 == 0, F.concat(at(0), F.lit(" et al."))).when(k % 5 == 1, F.concat(at(3), F.lit(" & "), at(5))).when(k % 5 == 2, "Zyzzqx, Q.").when(k % 5 == 3, at(0))
    authors = F.when(k % 13 == 0, None).when(k % 13 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(at(1), F.lit(" "), at(0)), F.concat(at(2), F.lit(", "), at(3))))
    c = w.select("doc_id", author.alias("author"), (2000 + k % 4).alias("year"), F.when(k % 2 == 0, "pmid").otherwise("doi").alias("kind"), authors.alias("authors"))
    found = health.citation_issues(F.col("author"), F.col("year"), F.col("kind"), F.col("authors"), F.lit(2001))
    return c.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.issue")


@query("backfill_stats", f"WITH {A.EDGES_SQL} SELECT 'scanned' AS kind, 'all' AS value, (SELECT count(*) FROM documents) AS n UNION ALL SELECT 'with_edges', 'all', count(DISTINCT from_path) FROM edges UNION ALL SELECT 'edge_type', edge_type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM edges GROUP BY 2")
def backfill_stats(spark, d):
    return health.backfill_stats(table(spark, d, "documents").select("doc_id"), A.typed_edges(spark, d))
