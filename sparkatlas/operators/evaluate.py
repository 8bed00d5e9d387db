"""Quality of rankings and classifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Labels:
    """Relevance by label: every other key of a query's label is relevant. own: query_id, label. keys: key, label.

    The pairs are as many as the squares of the labels' sizes, and never made.
    """

    own: DataFrame
    keys: DataFrame

    def sizes(self) -> DataFrame:
        """(query_id, n_relevant) of the queries that have relevant keys."""
        keys = self.keys.where("label IS NOT NULL").distinct()
        n = keys.groupBy("label").agg(F.count("*").alias("n"))
        itself = keys.select(F.col("key").alias("query_id"), "label", F.lit(1).alias("itself"))
        per = self.own.distinct().join(n, "label").join(itself, ["query_id", "label"], "left")
        return per.groupBy("query_id").agg(F.sum(F.col("n") - F.coalesce("itself", F.lit(0))).alias("n_relevant")).where("n_relevant > 0")

    def hits(self, ranked: DataFrame) -> DataFrame:
        """The rows of ranked whose key is relevant."""
        own = self.own.select("query_id", F.col("label").alias("_label"))
        found = ranked.where("key <> query_id").join(own, "query_id").join(self.keys.select("key", "label"), "key")
        return found.where("label = _label").drop("label", "_label").distinct()


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame | Labels) -> DataFrame:
    """Mean recall@5, recall@10, reciprocal rank and hits@1 over the queries that have relevant keys.

    ranked: query_id, key, rank. relevant: query_id, key, or Labels. Queries without results count as zero.
    """
    first = ranked.select("query_id", "key", "rank").where(F.col("rank") <= 10)
    if isinstance(relevant, Labels):
        sizes, found = relevant.sizes(), relevant.hits(first)
    else:
        truth = relevant.distinct()
        sizes, found = truth.groupBy("query_id").agg(F.count("*").alias("n_relevant")), first.join(truth, ["query_id", "key"])
    hits = found.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= 5, 1).otherwise(0)).alias("in5"), F.count("*").alias("in10"), F.min("rank").alias("first"))
    per = sizes.join(hits, "query_id", "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("n_relevant"), F.lit(0.0))
    return per.agg(
        F.count("*").alias("num_queries"),
        F.round(F.avg(share("in5")), 6).alias("recall_at_5"),
        F.round(F.avg(share("in10")), 6).alias("recall_at_10"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("first") == 1, 1.0).otherwise(0.0)), 6).alias("hits_at_1"),
    )


def rank_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per query: keys new in the first five and ten, and keys that rose or fell among those in both."""
    b = before.select("query_id", "key", F.col("rank").alias("old"))
    both = after.join(b, ["query_id", "key"], "left")
    new = lambda k: F.sum(F.when((F.col("rank") <= k) & (F.col("old").isNull() | (F.col("old") > k)), 1).otherwise(0))
    return both.groupBy("query_id").agg(new(5).alias("new_at_5"), new(10).alias("new_at_10"), F.sum(F.when(F.col("rank") < F.col("old"), 1).otherwise(0)).alias("promoted"), F.sum(F.when(F.col("rank") > F.col("old"), 1).otherwise(0)).alias("demoted"))


def overlap_and_rho(a: DataFrame, b: DataFrame, at: tuple[int, ...] = (5, 10), top: int = 20) -> DataFrame:
    """Per query the shared part of the first k, and a rank correlation on the positions within each top list.

    Positions are those of the whole lists, so the value may leave [-1, 1]; with fewer than two keys in common it is 0.
    """
    both = a.where(F.col("rank") <= top).join(b.select("query_id", "key", F.col("rank").alias("other")).where(F.col("other") <= top), ["query_id", "key"])
    n, d2 = F.count("*"), F.sum((F.col("rank") - F.col("other")) * (F.col("rank") - F.col("other")))
    shared = [(F.sum(F.when((F.col("rank") <= k) & (F.col("other") <= k), 1).otherwise(0)) / k).alias(f"overlap_{k}") for k in at]
    found = both.groupBy("query_id").agg(*shared, F.when(n < 2, 0.0).otherwise(1 - 6.0 * d2 / (n * (n * n - 1))).alias("rho"))
    queries = a.select("query_id").distinct()
    return queries.join(found, "query_id", "left").na.fill(0.0)


def classifier_precision(labelled: DataFrame, by: list[str], right: Column, nearly: Column) -> DataFrame:
    """Strict and loose precision: right ones, and those right or of the wrong type, over all labelled."""
    n = F.count("*")
    strict, loose = F.sum(F.when(right, 1).otherwise(0)), F.sum(F.when(right | nearly, 1).otherwise(0))
    return labelled.groupBy(*by).agg(n.alias("n"), F.round(strict / n, 6).alias("strict"), F.round(loose / n, 6).alias("loose"))


def evaluation_set(links: DataFrame, notes: DataFrame, min_links: int = 2) -> DataFrame:
    """(query_id, text, key): a note's title as query, the notes it links to as relevant, for notes with enough links."""
    pairs = links.select(F.col("src").alias("query_id"), F.col("dst").alias("key")).where("query_id <> key").distinct()
    enough = pairs.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_links).select("query_id")
    return pairs.join(enough, "query_id").join(notes.select(F.col("key").alias("query_id"), F.col("title").alias("text")), "query_id")


def feedback_grid(vecs: DataFrame, queries: DataFrame, relevant: DataFrame | Labels, configs: list[tuple[float, int]]) -> DataFrame:
    """Metrics per feedback configuration (alpha, k), and without feedback.

    A query's own note is dropped after the cut at ten, as the harness this follows does.
    """
    from sparkatlas.operators import vectors
    from sparkatlas.operators.storage import written

    base = written(vectors.top_k(vecs, queries, 10), "grid-base")
    cut = lambda r: r.where(F.col("rank") <= 10).where("key <> query_id")
    out = retrieval_metrics(cut(base), relevant).withColumn("label", F.lit("none"))
    for alpha, k in configs:
        moved = vectors.rocchio(vecs, queries, base, alpha, 1 - alpha, k)
        ranked = vectors.top_k(vecs, moved, 10)
        out = out.unionByName(retrieval_metrics(cut(ranked), relevant).withColumn("label", F.lit(f"a={alpha:g},k={k}")))
    return out


def feedback_strategies(vecs: DataFrame, queries: DataFrame, configs: list[tuple[float, int]], top: int = 30) -> DataFrame:
    """(strategy, alpha, k, query_id, new_at_5, new_at_10, promoted, demoted) of feedback against none.

    replace: the moved query's list stands alone; hybrid: both lists are fused;
    two-pass: the query is moved a second time by what the moved one finds.
    """
    from sparkatlas.operators import fusion, vectors
    from sparkatlas.operators.storage import written

    base = written(vectors.top_k(vecs, queries, top), "feedback-base")
    out = None
    for alpha, k in configs:
        moved = written(vectors.rocchio(vecs, queries, base, alpha=alpha, beta=1 - alpha, k=k), "feedback-moved")
        again = written(vectors.top_k(vecs, moved, top), "feedback-list")
        twice = vectors.top_k(vecs, vectors.rocchio(vecs, moved, again, alpha=alpha, beta=1 - alpha, k=k), top)
        for name, found in (("replace", again), ("hybrid", fusion.rrf([base, again], top=top, digits=12)), ("two-pass", twice)):
            shift = rank_shift(base, found).select(F.lit(name).alias("strategy"), F.lit(alpha).alias("alpha"), F.lit(k).alias("k"), "query_id", "new_at_5", "new_at_10", "promoted", "demoted")
            out = shift if out is None else out.unionByName(shift)
    return out


def compare_models(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], top: int = 20) -> DataFrame:
    """Per query overlap@5, overlap@10 and rank correlation of two models, each (vecs, query vecs)."""
    from sparkatlas.operators import vectors

    return overlap_and_rho(*(vectors.top_k(v, q, top) for v, q in (first, second)), top=top)
