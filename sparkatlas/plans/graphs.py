"""Queries over links and typed edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkatlas.functions import text as T
from sparkatlas.operators import graph, reports
from sparkatlas.plans import adapters as A
from sparkatlas.plans.registry import query, table


@query(
    "link_graph_degree",
    f"""WITH {A.LINKS_SQL},
n AS (SELECT src AS node, 1 AS o, 0 AS i FROM links UNION ALL SELECT dst, 0, 1 FROM links)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM n GROUP BY node""",
)
def link_graph_degree(spark, d):
    return graph.degrees(A.links(spark, d))


@query("undirected_graph", f"WITH {A.LINKS_SQL} SELECT src, dst FROM links WHERE src <> dst UNION SELECT dst, src FROM links WHERE src <> dst")
def undirected_graph(spark, d):
    return graph.link_graph(A.all_links(spark, d))


def _ppr_sql(rounds: int = 20) -> str:
    parts = [
        A.LINKS_SQL,
        "g AS (SELECT src, dst FROM links WHERE src <> dst UNION SELECT dst, src FROM links WHERE src <> dst)",
        "deg AS (SELECT src, count(*) AS degree FROM g GROUP BY src)",
        "e AS MATERIALIZED (SELECT g.src, g.dst, degree FROM g JOIN deg USING (src))",
        "seeds AS (SELECT DISTINCT s_suppkey AS query_id, s_suppkey AS node FROM supplier WHERE s_suppkey % 50 = 0)",
        "ind AS (SELECT dst AS node, count(*) AS n FROM links GROUP BY dst)",
        "w AS (SELECT query_id, s.node, 1.0 / (coalesce(n, 0) + 1) AS w FROM seeds s JOIN deg ON deg.src = s.node LEFT JOIN ind ON ind.node = s.node)",
        "r0 AS MATERIALIZED (SELECT query_id, node, w / sum(w) OVER (PARTITION BY query_id) AS score FROM w)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT query_id, node, sum(score) AS score FROM (SELECT query_id, dst AS node, 0.5 * sum(score / degree) AS score FROM r{i - 1} JOIN e ON e.src = node GROUP BY query_id, dst UNION ALL SELECT query_id, node, 0.5 * score FROM r0) GROUP BY query_id, node)")
    parts.append(f"k AS (SELECT r.* FROM r{rounds} r WHERE score > 1e-6 AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = r.query_id AND s.node = r.node))")
    parts.append("t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, node) AS rank FROM k)")
    return "WITH " + ",\n".join(parts) + "\nSELECT query_id, node, round(score, 6) AS score, rank FROM t WHERE rank <= 30"


@query("ppr_supplier_graph", _ppr_sql())
def ppr_supplier_graph(spark, d):
    """The best nodes of each seed; scores that are equal to ten digits go by node."""
    links = A.all_links(spark, d)
    seeds = table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("node"))
    # in-degrees are asked of seeds only
    into = links.join(seeds.select(F.col("node").alias("dst")), "dst", "left_semi").distinct()
    found = graph.personalised_pagerank(graph.link_graph(links), seeds, graph.degrees(into))
    return found.select("query_id", "node", F.round("score", 6).alias("score"), "rank")


STARTS_SQL = "starts AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 50 = 0)"


def _starts(spark, d):
    """The stated starts of walks: every order whose key is divisible by 50."""
    return table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("node"))


@query(
    "downstream_edges",
    f"""WITH RECURSIVE {A.LINEAGE_SQL}, {STARTS_SQL},
live AS (SELECT DISTINCT from_path, to_path, edge_type FROM lineage WHERE NOT archived),
walk AS (SELECT node AS start, from_path, to_path, edge_type, 1 AS depth FROM starts JOIN live ON from_path = node
         UNION SELECT w.start, l.from_path, l.to_path, l.edge_type, w.depth + 1 FROM walk w JOIN live l ON l.from_path = w.to_path WHERE w.depth < 10)
SELECT * FROM walk""",
)
def downstream_edges(spark, d):
    return graph.downstream(A.lineage(spark, d), _starts(spark, d))


@query(
    "symmetric_reach",
    f"""WITH RECURSIVE {A.LINEAGE_SQL}, {STARTS_SQL},
both_ways AS (SELECT from_path AS a, to_path AS b FROM lineage WHERE NOT archived UNION SELECT to_path, from_path FROM lineage WHERE NOT archived),
walk AS (SELECT node AS start, node, 0 AS depth FROM starts UNION SELECT w.start, b, w.depth + 1 FROM walk w JOIN both_ways ON a = w.node WHERE w.depth < 10)
SELECT start, node, min(depth) AS depth FROM walk WHERE node <> start GROUP BY start, node""",
)
def symmetric_reach(spark, d):
    return graph.symmetric_reach(A.lineage(spark, d), _starts(spark, d))


SOLE_EDGES = "e AS (SELECT DISTINCT l_partkey AS from_path, l_orderkey AS to_path FROM lineitem)"


def _support(spark, d):
    """Edges, which repeat where an order has a part twice."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("from_path"), F.col("l_orderkey").alias("to_path"))


@query("sole_support", f"WITH {SOLE_EDGES} SELECT from_path AS supporter, to_path AS dependent FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.to_path = x.to_path AND y.from_path <> x.from_path)")
def sole_support(spark, d):
    return graph.sole_support(_support(spark, d))


@query(
    "sole_support_symmetric",
    f"""WITH {SOLE_EDGES}, s AS (SELECT from_path + 1000000000 AS a, to_path AS b FROM e), t AS (SELECT a, b FROM s UNION SELECT b, a FROM s)
SELECT min(a) AS supporter, b AS dependent FROM t GROUP BY b HAVING count(DISTINCT a) = 1""",
)
def sole_support_symmetric(spark, d):
    edges = _support(spark, d).select((F.col("from_path") + 1000000000).alias("from_path"), "to_path")
    return graph.sole_support(edges, symmetric=True)


@query(
    "impact_severity",
    f"""WITH {SOLE_EDGES}, c AS (SELECT to_path, count(*) AS n FROM e GROUP BY to_path)
SELECT CASE WHEN n = 1 THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM e JOIN c USING (to_path) GROUP BY 1""",
)
def impact_severity(spark, d):
    edges = _support(spark, d).distinct()
    sole = graph.sole_support(edges).select(F.col("dependent").alias("to_path"), F.lit(True).alias("sole"))
    joined = edges.join(sole, "to_path", "left").withColumn("sole", F.coalesce("sole", F.lit(False)))
    return joined.groupBy(graph.impact_severity("rebutting").alias("severity")).agg(F.count("*").alias("n"))


@query(
    "edge_stats",
    f"""WITH {A.EDGES_SQL}, k AS (SELECT 'total' AS kind, 'all' AS value FROM edges UNION ALL SELECT 'edge_type', edge_type FROM edges
UNION ALL SELECT 'confidence', confidence FROM edges UNION ALL SELECT 'source_graph', source_graph FROM edges) SELECT kind, value, count(*) AS n FROM k GROUP BY kind, value""",
)
def edge_stats(spark, d):
    return reports.edge_stats(A.typed_edges(spark, d))


@query("edge_review", f"WITH {A.EDGES_SQL} SELECT from_path, to_path, edge_type, count(*) AS n FROM edges WHERE confidence = 'medium' GROUP BY ALL")
def edge_review(spark, d):
    return A.typed_edges(spark, d).where("confidence = 'medium'").groupBy("from_path", "to_path", "edge_type").agg(F.count("*").alias("n"))


@query(
    "frontmatter_edges",
    f"""WITH {A.EDGES_SQL} SELECT from_path, edge_type, array_to_string(list_sort(list(DISTINCT to_path)), ',') AS targets FROM edges WHERE confidence = 'high' AND NOT archived GROUP BY from_path, edge_type""",
)
def frontmatter_edges(spark, d):
    edges = A.typed_edges(spark, d).where("confidence = 'high' AND NOT archived")
    return edges.groupBy("from_path", "edge_type").agg(F.array_join(F.array_sort(F.collect_set("to_path")), ",").alias("targets"))


@query("zero_inlink", "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM labels) ORDER BY 1")
def zero_inlink(spark, d):
    """Customers seen as notes, labels as the links to them."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("node")).join(table(spark, d, "labels").select(F.col("doc_id").alias("node")), "node", "left_anti")


HREF = "href=\"/([^\"]*)\""


@query("html_links", "SELECT page_id, lower(trim(unnest(list_distinct(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))))) AS target FROM pages")
def html_links(spark, d):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), 1))
    return table(spark, d, "pages").select("page_id", F.explode(found).alias("target")).select("page_id", F.lower(F.trim("target")).alias("target"))


@query(
    "broken_links",
    """WITH l AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1))) AS target FROM pages),
names AS (SELECT DISTINCT lower(regexp_extract(url, '/([^/?]*)(?:\\?[^/]*)?$', 1)) AS target FROM pages)
SELECT page_id, target FROM l WHERE target NOT IN (SELECT target FROM names)""",
)
def broken_links(spark, d):
    pages = table(spark, d, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("target")).select("page_id", F.lower("target").alias("target")).distinct()
    names = pages.select(F.lower(F.regexp_extract("url", r"/([^/?]*)(?:\?[^/]*)?$", 1)).alias("target")).distinct()
    return links.join(names, "target", "left_anti").select("page_id", "target")


@query(
    "ghost_duplicates",
    """WITH n AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM n a WHERE source = 'src0' AND EXISTS (SELECT 1 FROM n b WHERE b.text = a.text AND b.source <> 'src0')""",
)
def ghost_duplicates(spark, d):
    n = table(spark, d, "documents").select("doc_id", "source", "text", F.sha2("text", 256).alias("h"))
    promoted = n.where("source <> 'src0'").select("h")
    return n.where("source = 'src0'").join(promoted, "h", "left_semi").select("doc_id")


@query(
    "folder_stats",
    f"""WITH {A.NOTES_SQL}, linked AS (SELECT DISTINCT doc_id AS key FROM labels)
SELECT folder, count(*) AS n, count(*) FILTER (WHERE l.key IS NULL) AS zero_inlinks FROM notes n LEFT JOIN linked l ON l.key = n.key GROUP BY folder""",
)
def folder_stats(spark, d):
    linked = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.lit(True).alias("linked")).distinct()
    joined = A.notes(spark, d).select("key", T.top_folder(F.col("path")).alias("folder")).join(linked, "key", "left")
    return joined.groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.when(F.col("linked").isNull(), 1).otherwise(0)).alias("zero_inlinks"))
