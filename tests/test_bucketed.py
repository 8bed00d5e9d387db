"""Edges dealt once: no round of a walk moves them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkatlas.operators.storage import bucketed


def test_no_exchange_over_edges(spark):
    edges = spark.range(2000).select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 2000).alias("dst"), F.lit(1).alias("degree"))
    table, name = bucketed(edges, "src", "test_edges")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        score = spark.range(2000).select(F.col("id").alias("node"), F.lit(1.0).alias("s")).groupBy("node").agg(F.sum("s").alias("s"))
        flow = score.join(table, score.node == table.src).select(F.col("dst").alias("node"), (F.col("s") / F.col("degree")).alias("s"))
        again = flow.groupBy("node").agg(F.sum("s").alias("s"))
        assert again.agg(F.sum("s")).first()[0] == 2000
        plan = again._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin") :]
        assert join.count("Exchange hashpartitioning(node") <= 1 and "hashpartitioning(src" not in plan and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
