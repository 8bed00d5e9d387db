"""The standard tables seen as notes, logs, links and typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.operators import sessions, vectors
from sparkatlas.plans.registry import table

#: "Now" of the event log, so that ages do not depend on the day of the run.
NOW = 1706745600.0


def notes(spark: SparkSession, d: str) -> DataFrame:
    """documents as notes: key, path (source folder), title (first line), body, tags."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("key"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.substring(F.split(t, "\n")[0], 1, 60).alias("title"),
        t.alias("body"),
        F.concat_ws(" ", "source", "lang").alias("tags"),
        F.col("source").alias("folder"),
        (F.lit(NOW) - F.col("doc_id") * 3600.0).alias("mtime"),
        F.pmod("doc_id", F.lit(25)).alias("session_id"),
    )


NOTES_SQL = """notes AS (SELECT doc_id AS key, source || '/' || doc_id || '.md' AS path, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 60) AS title,
    coalesce(text, '') AS body, source AS folder, 1706745600.0 - doc_id * 3600.0 AS mtime, doc_id % 25 AS session_id FROM documents)"""


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label")


def query_vecs(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries of searches: every vector whose id is divisible by 50."""
    return vecs(spark, d).where("key % 50 = 0").select(F.col("key").alias("query_id"), "vec")


VECS_SQL = """vecs AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
q AS (SELECT key AS query_id, vec FROM vecs WHERE key % 50 = 0)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    """events as a log: sec (seconds), session, action, value and the number k of its payload."""
    return table(spark, d, "events").select("event_id", sessions.epoch("ts").alias("sec"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


LOG_SQL = """log AS (SELECT event_id, epoch_us(ts) / 1e6 AS sec, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def all_links(spark: SparkSession, d: str) -> DataFrame:
    """Part-to-supplier links, as a directed edge table over numbered nodes, as often as they occur."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") + 1000000000).alias("src"), F.col("l_suppkey").alias("dst"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """all_links, each once."""
    return all_links(spark, d).distinct()


LINKS_SQL = "links AS (SELECT DISTINCT l_partkey + 1000000000 AS src, l_suppkey AS dst FROM lineitem)"


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges between orders' parts and suppliers: type by return flag, archived by line status."""
    line = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "N", "extends").otherwise("contradicts")
    confidence = F.when(F.col("l_linenumber") % 3 == 0, "medium").when(F.col("l_linenumber") % 3 == 1, "high").otherwise("low")
    return line.select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("from_path"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("to_path"),
        kind.alias("edge_type"),
        confidence.alias("confidence"),
        F.when(F.col("l_tax") > 0.04, "peer").otherwise("local").alias("source_graph"),
        (F.col("l_linestatus") == "F").alias("archived"),
    )


EDGES_SQL = """edges AS (SELECT 'p' || l_partkey AS from_path, 's' || l_suppkey AS to_path,
    CASE WHEN l_returnflag = 'A' THEN 'supports' WHEN l_returnflag = 'N' THEN 'extends' ELSE 'contradicts' END AS edge_type,
    CASE WHEN l_linenumber % 3 = 0 THEN 'medium' WHEN l_linenumber % 3 = 1 THEN 'high' ELSE 'low' END AS confidence,
    CASE WHEN l_tax > 0.04 THEN 'peer' ELSE 'local' END AS source_graph, (l_linestatus = 'F') AS archived FROM lineitem)"""


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges from each order to the customer's next one; archived where the order is fulfilled."""
    from pyspark.sql import Window

    later = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, d, "orders").withColumn("next", F.lead("o_orderkey").over(later)).where("next IS NOT NULL")
    return orders.select(F.col("o_orderkey").alias("from_path"), F.col("next").alias("to_path"), F.col("o_orderpriority").alias("edge_type"), (F.col("o_orderstatus") == "F").alias("archived"))


LINEAGE_SQL = """chain AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next, o_orderpriority, o_orderstatus FROM orders),
lineage AS (SELECT o_orderkey AS from_path, next AS to_path, o_orderpriority AS edge_type, o_orderstatus = 'F' AS archived FROM chain WHERE next IS NOT NULL)"""


def unit_vecs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.unit(vecs(spark, d))
