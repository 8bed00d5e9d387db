"""Queries of lookups, reviews and prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkatlas.functions import prose
from sparkatlas.operators import health, lookup, review
from sparkatlas.plans import adapters as A
from sparkatlas.plans.registry import query, table

NODES_SQL = "nodes AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey % 50 = 0 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 50 = 0)"


def _nodes(spark, d):
    """The stated notes: parts and suppliers whose key is divisible by 50."""
    p = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return p.unionByName(table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))


@query(
    "note_edges",
    f"""WITH {A.EDGES_SQL}, {NODES_SQL},
e AS (SELECT from_path AS node, 'out' AS direction, to_path AS other, edge_type FROM edges UNION ALL SELECT to_path, 'in', from_path, edge_type FROM edges)
SELECT node, direction, edge_type, count(*) AS n, count(DISTINCT other) AS n_other FROM e WHERE node IN (SELECT node FROM nodes) GROUP BY ALL""",
)
def note_edges(spark, d):
    found = lookup.note_edges(A.typed_edges(spark, d), _nodes(spark, d))
    return found.groupBy("node", "direction", "edge_type").agg(F.count("*").alias("n"), F.countDistinct("other").alias("n_other"))


@query(
    "note_links",
    f"""WITH {A.LINKS_SQL}, nodes AS (SELECT s_suppkey AS node FROM supplier UNION SELECT p_partkey + 1000000000 FROM part)
SELECT node, (SELECT count(*) FROM links WHERE dst = node) AS n_in, (SELECT count(*) FROM links WHERE src = node) AS n_out FROM nodes""",
)
def note_links(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")).unionByName(table(spark, d, "part").select((F.col("p_partkey") + 1000000000).alias("node")))
    return lookup.note_links(A.links(spark, d), nodes)


@query("zero_outlink", "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION SELECT -o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def zero_outlink(spark, d):
    """Customers without orders and orders (negative) without lines."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    notes = table(spark, d, "customer").select(F.col("c_custkey").alias("node")).unionByName(orders.select((-F.col("o_orderkey")).alias("node")))
    return lookup.zero_outlink(notes, orders.select(F.col("o_custkey").alias("src")).unionByName(lines.select((-F.col("l_orderkey")).alias("src"))))


WANTED_SQL = "wanted AS (SELECT doc_id AS wanted_id, CASE WHEN doc_id % 100 = 0 THEN source || '/' || doc_id || '.md' WHEN doc_id % 150 = 50 THEN doc_id || '.md' ELSE 'gone' || doc_id || '.md' END AS name FROM documents WHERE doc_id % 50 = 0)"


@query(
    "path_lookup",
    f"""WITH {A.NOTES_SQL}, {WANTED_SQL},
x AS (SELECT wanted_id, name, min(n.path) AS whole FROM wanted LEFT JOIN notes n ON n.path = name GROUP BY ALL),
y AS (SELECT wanted_id, name, min(n.path) AS by_end FROM wanted LEFT JOIN notes n ON ends_with(n.path, name) GROUP BY ALL)
SELECT x.wanted_id, x.name, coalesce(whole, by_end) AS path FROM x JOIN y ON x.wanted_id = y.wanted_id""",
)
def path_lookup(spark, d):
    k = F.col("doc_id")
    whole = F.concat("source", F.lit("/"), k, F.lit(".md"))
    name = F.when(k % 100 == 0, whole).when(k % 150 == 50, F.concat(k, F.lit(".md"))).otherwise(F.concat(F.lit("gone"), k, F.lit(".md")))
    wanted = table(spark, d, "documents").where("doc_id % 50 = 0").select(k.alias("wanted_id"), name.alias("name"))
    return lookup.find_paths(A.notes(spark, d), wanted)


@query("fetch_bodies", f"WITH {A.NOTES_SQL} SELECT key, path, md5(body) AS body FROM notes WHERE key IN (SELECT doc_id FROM labels WHERE quality = 0)")
def fetch_bodies(spark, d):
    keys = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("key"))
    return lookup.fetch(A.notes(spark, d), keys, ["path", "body"]).withColumn("body", F.md5("body"))


@query("notes_with_content", f"WITH {A.NOTES_SQL} SELECT n.key, n.path, t.text AS body FROM notes n LEFT JOIN (SELECT conv_id AS key, text FROM conversations WHERE turn = 0) t USING (key)")
def notes_with_content(spark, d):
    content = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("key"), F.col("text").alias("body"))
    return lookup.with_content(A.notes(spark, d).select("key", "path"), content)


@query("stratified_sample", f"WITH {A.EDGES_SQL}, e AS (SELECT confidence, from_path || '>' || to_path AS edge FROM edges GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY confidence ORDER BY md5('7:' || edge), edge) AS pick FROM e) SELECT * FROM r WHERE pick <= 20")
def stratified_sample(spark, d):
    edges = A.typed_edges(spark, d).select("confidence", F.concat_ws(">", "from_path", "to_path").alias("edge"))
    return lookup.stratified_sample(edges, "confidence", "edge", 20, seed=7, once=True)


@query("unvisited_pick", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5('1:' || doc_id), doc_id LIMIT 25")
def unvisited_pick(spark, d):
    return lookup.unvisited_pick(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", 25, seed=1)


@query("limbo_oldest", f"WITH {A.NOTES_SQL}, r AS (SELECT folder, key, row_number() OVER (PARTITION BY folder ORDER BY mtime, key) AS rank FROM notes) SELECT folder, key, rank FROM r WHERE rank <= 5")
def limbo_oldest(spark, d):
    return lookup.oldest(A.notes(spark, d), "folder").select("folder", "key", "rank")


@query("clusters_by_size", "SELECT label AS cluster, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM embeddings GROUP BY label")
def clusters_by_size(spark, d):
    return lookup.by_size(A.vecs(spark, d).select(F.col("label").alias("cluster"), "key"))


@query("not_injected", f"WITH {A.LOG_SQL} SELECT DISTINCT user_id AS session_id, k AS path FROM log WHERE event_type <> 'view' AND (user_id, k) NOT IN (SELECT (user_id, k) FROM log WHERE event_type = 'view')")
def not_injected(spark, d):
    rows = A.log(spark, d).select(F.col("user_id").alias("session_id"), F.col("k").alias("path"), "event_type")
    return lookup.not_injected(rows.where("event_type <> 'view'").drop("event_type").distinct(), rows.where("event_type = 'view'"))


@query("event_dedupe", f"WITH {A.LOG_SQL}, r AS (SELECT event_id, CASE WHEN k % 10 <> 0 THEN user_id::VARCHAR END AS s, CASE WHEN k % 10 <> 0 THEN event_type ELSE '' END AS a, CASE WHEN k % 10 <> 0 THEN k::VARCHAR ELSE ' ' END AS p FROM log) SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY s, a, p ORDER BY event_id) AS n FROM r) WHERE n = 1 OR (s IS NULL AND a = '' AND p = ' ')")
def event_dedupe(spark, d):
    told = F.col("k") % 10 != 0
    e = A.log(spark, d).select("event_id", F.when(told, F.col("user_id").cast("string")).alias("s"), F.when(told, F.col("event_type")).otherwise("").alias("a"), F.when(told, F.col("k").cast("string")).otherwise(" ").alias("p"))
    return lookup.first_of_event(e, ["s", "a", "p"], "event_id").select("event_id")


@query(
    "health_dashboard",
    f"""WITH {A.NOTES_SQL}, {A.LINKS_SQL}
SELECT 'stale_inbox' AS "check", count(*) AS n FROM notes WHERE folder IN ('src0', 'src1') AND 1706745600.0 - mtime > 14 * 86400.0
UNION ALL SELECT 'orphans', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'unindexed', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'ghosts', count(*) FROM documents a WHERE source = 'src0' AND text IS NOT NULL AND EXISTS (SELECT 1 FROM documents b WHERE b.text = a.text AND b.source <> 'src0')
UNION ALL SELECT 'near_duplicates', (SELECT count(*) FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) x JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) y ON x.vec_id < y.vec_id WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= 0.38)
UNION ALL SELECT 'broken_links', (SELECT count(*) FROM (WITH l AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1))) AS target FROM pages), names AS (SELECT DISTINCT lower(regexp_extract(url, '/([^/?]*)(?:\\?[^/]*)?$', 1)) AS target FROM pages) SELECT page_id, target FROM l WHERE target NOT IN (SELECT target FROM names)))
UNION ALL SELECT 'queue', count(*) FROM labels WHERE quality = 0""",
)
def health_dashboard(spark, d):
    from sparkatlas.operators import vectors
    from sparkatlas.plans import graphs, retrieval

    docs, labels, notes = table(spark, d, "documents"), table(spark, d, "labels"), A.notes(spark, d)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return review.dashboard(
        {
            "stale_inbox": review.stale_inbox(notes, ["src0", "src1"], A.NOW),
            "orphans": lookup.zero_outlink(customers, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"))),
            "unindexed": docs.join(labels, "doc_id", "left_anti"),
            "ghosts": graphs.ghost_duplicates(spark, d),
            "near_duplicates": vectors.similar_pairs(A.unit_vecs(spark, d), retrieval.NEAR),
            "broken_links": graphs.broken_links(spark, d),
            "queue": labels.where("quality = 0"),
        }
    )


@query(
    "memory_consolidation",
    f"""WITH {A.NOTES_SQL}, m AS (SELECT key, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END::BIGINT AS n_lines, length(body)::BIGINT AS n_chars, 1706745600.0 - mtime > 90 * 86400.0 AS expired FROM notes),
s AS (SELECT *, CASE WHEN n_chars > 1000 THEN 'split' WHEN n_chars > 500 OR n_lines > 15 THEN 'shorten' ELSE 'ok' END AS size FROM m) SELECT * FROM s WHERE size <> 'ok' OR expired""",
)
def memory_consolidation(spark, d):
    return review.consolidation(A.notes(spark, d).select("key", F.col("body").alias("text"), "mtime"), A.NOW)


@query("promotion_clusters", "SELECT source, count(*) AS n, round(avg(quality::DOUBLE), 6) AS share_deep FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING round(avg(quality::DOUBLE), 6) >= 0.8")
def promotion_clusters(spark, d):
    claims = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return review.promotable(claims, "source", F.col("quality") == 1)


@query("densest_unreviewed", "WITH c AS (SELECT conv_id AS cluster, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1) SELECT cluster, n, row_number() OVER (ORDER BY n DESC, cluster) AS rank FROM c ORDER BY rank LIMIT 10")
def densest_unreviewed(spark, d):
    clusters = table(spark, d, "conversations").select(F.col("conv_id").alias("cluster"), F.col("conv_id").alias("key"))
    return review.densest_unreviewed(clusters, table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key")), top=10)


@query("iso_time", f"WITH {A.LOG_SQL} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, (DATE '1970-01-01' + (event_id % 40000 - 20000)::INT)::VARCHAR AS day FROM log")
def iso_time(spark, d):
    days = (F.col("event_id") % 40000 - 20000).cast("int")
    return A.log(spark, d).select("event_id", prose.iso_time(F.col("sec")).alias("iso"), prose.civil_from_days(days).cast("string").alias("day"))


@query("entailment_label", f"WITH {A.LOG_SQL}, l AS (SELECT event_id, k % 5 AS c, k % 3 AS n, k % 4 AS e FROM log) SELECT event_id, CASE WHEN e >= c AND e >= n THEN 'entailment' WHEN c >= n THEN 'contradiction' ELSE 'neutral' END AS label, round(exp(greatest(c, n, e)) / (exp(c) + exp(n) + exp(e)), 6) AS share FROM l")
def entailment_label(spark, d):
    k = F.col("k")
    found = A.log(spark, d).select("event_id", prose.entailment((k % 5).cast("double"), (k % 3).cast("double"), (k % 4).cast("double")).alias("x"))
    return found.select("event_id", "x.label", F.round("x.share", 6).alias("share"))


@query("without_dashes", "SELECT conv_id, turn, regexp_replace(replace(text, ' and ', ' — '), '\\s*—\\s*', ', ', 'g') AS text FROM conversations")
def without_dashes(spark, d):
    text = F.replace("text", F.lit(" and "), F.lit(" — "))
    return table(spark, d, "conversations").select("conv_id", "turn", prose.without_dashes(text).alias("text"))


@query("inbox_routes", "SELECT CASE source WHEN 'src0' THEN 'inbox' WHEN 'src1' THEN 'fleeting' ELSE source END AS folder, CASE WHEN doc_id % 4 = 0 THEN 'link_check' WHEN source IN ('src0', 'src1') THEN 'voice_gate' ELSE 'none' END AS route, count(*) AS n FROM documents GROUP BY ALL")
def inbox_routes(spark, d):
    folder = F.when(F.col("source") == "src0", "inbox").when(F.col("source") == "src1", "fleeting").otherwise(F.col("source"))
    docs = table(spark, d, "documents").select(folder.alias("folder"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(2).alias("inlinks"))
    return docs.groupBy("folder", health.route(F.col("inlinks"), F.col("folder")).alias("route")).agg(F.count("*").alias("n"))


PLACE_SQL = "CASE WHEN doc_id % 3 = 0 THEN '3-permanent' WHEN doc_id % 7 = 0 THEN '5-maps' ELSE source END || '/' || doc_id || '.md'"


@query(
    "link_stats",
    f"""WITH n AS (SELECT {PLACE_SQL} AS path, doc_id::VARCHAR AS name FROM documents), l AS (SELECT conv_id || CASE WHEN turn = 3 THEN '[1]' ELSE '' END AS target FROM conversations), s AS (SELECT target FROM l WHERE NOT contains(target, '[')),
f AS (SELECT split_part(path, '/', 1) AS name, count(*) AS n, count(*) FILTER (WHERE name NOT IN (SELECT target FROM s)) AS zero_inlinks FROM n GROUP BY 1)
SELECT 'folder' AS kind, name, n, zero_inlinks, NULL::DOUBLE AS ratio FROM f UNION ALL SELECT 'total', 'notes', count(*), NULL, NULL FROM n UNION ALL SELECT 'total', 'links', count(*), NULL, NULL FROM s
UNION ALL SELECT 'ratio', 'permanent to maps', NULL, NULL, round((SELECT n FROM f WHERE name = '3-permanent') / (SELECT n FROM f WHERE name = '5-maps'), 2)""",
)
def link_stats(spark, d):
    """Turns of a conversation as links to the note of its number, some with a bracket."""
    k = F.col("doc_id")
    place = F.when(k % 3 == 0, "3-permanent").when(k % 7 == 0, "5-maps").otherwise(F.col("source"))
    notes = table(spark, d, "documents").select(F.concat(place, F.lit("/"), k.cast("string"), F.lit(".md")).alias("path"))
    links = table(spark, d, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.when(F.col("turn") == 3, "[1]").otherwise("")).alias("target"))
    return lookup.link_stats(notes, links)


GHOST_SQL = "CASE doc_id % 3 WHEN 0 THEN '0-inbox' WHEN 1 THEN '1-fleeting' ELSE '3-permanent' END || '/' || lang || length(coalesce(text, '')) % 997 || '.md'"


@query("ghost_names", f"WITH n AS (SELECT doc_id, {GHOST_SQL} AS path FROM documents) SELECT doc_id, path FROM n WHERE path LIKE '0-inbox/%' AND split_part(path, '/', 2) IN (SELECT split_part(path, '/', 2) FROM n WHERE path NOT LIKE '0-inbox/%')")
def ghost_names(spark, d):
    """Inbox notes that were promoted under the same file name: files are named by language and length here."""
    k = F.col("doc_id") % 3
    folder = F.when(k == 0, "0-inbox").when(k == 1, "1-fleeting").otherwise("3-permanent")
    path = F.concat(folder, F.lit("/"), "lang", (F.length(F.coalesce("text", F.lit(""))) % 997).cast("string"), F.lit(".md"))
    return review.ghosts(table(spark, d, "documents").select("doc_id", path.alias("path")), "0-inbox", ("1-fleeting", "3-permanent"))
