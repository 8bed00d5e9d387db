"""Reviews of the collection: dashboard, clusters to merge or promote, memory consolidation, refinement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkatlas.operators.lookup import numbered
from sparkatlas.operators.storage import written

DAY = 86400.0


def dashboard(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n): how many rows each check of the collection's health finds."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def stale_inbox(notes: DataFrame, folders: list[str], now: float, days: float = 14) -> DataFrame:
    """Notes of the inbox folders that were not touched for more than so many days."""
    return notes.where(F.col("folder").isin(folders) & ((F.lit(now) - F.col("mtime")) > days * DAY))


def ghosts(notes: DataFrame, inbox: str, promoted: tuple[str, ...]) -> DataFrame:
    """Notes (path) of the inbox folder whose file name a promoted folder has too."""
    top, name = F.substring_index("path", "/", 1), F.substring_index("path", "/", -1)
    kept = notes.where(top.isin(*promoted)).select(name.alias("_name")).distinct()
    return notes.where(top == inbox).withColumn("_name", name).join(kept, "_name", "left_semi").drop("_name")


def overlapping_pairs(pairs: DataFrame, tags: DataFrame, least: int = 2) -> DataFrame:
    """Similar pairs (a, b, similarity) whose notes share at least so many tags. tags: key, tags (array)."""
    x, y = (tags.select(F.col("key").alias(k), F.array_distinct("tags").alias(f"{k}_tags")) for k in ("a", "b"))
    shared = F.size(F.array_intersect("a_tags", "b_tags")).alias("shared")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "similarity", shared).where(F.col("shared") >= least)


def consolidation(memories: DataFrame, now: float, lines: int = 15, soft: int = 500, hard: int = 1000, days: float = 90) -> DataFrame:
    """(key, n_lines, n_chars, size, expired) of memories that are too long or too old for the index."""
    text = F.coalesce("text", F.lit(""))
    n_lines, n_chars = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))), F.length(text)
    size = F.when(F.col("n_chars") > hard, "split").when((F.col("n_chars") > soft) | (F.col("n_lines") > lines), "shorten").otherwise("ok")
    out = memories.select("key", n_lines.cast("long").alias("n_lines"), n_chars.cast("long").alias("n_chars"), ((F.lit(now) - F.col("mtime")) > days * DAY).alias("expired"))
    return out.withColumn("size", size).where("size <> 'ok' OR expired")


def promotable(claims: DataFrame, by: str, deep: Column, share: float = 0.8) -> DataFrame:
    """(by, n, share_deep) of groups of which at least this share is deep."""
    out = claims.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.when(deep, 1.0).otherwise(0.0)), 6).alias("share_deep"))
    return out.where(F.col("share_deep") >= share)


def densest_unreviewed(clusters: DataFrame, reviewed: DataFrame, top: int = 1) -> DataFrame:
    """(cluster, n, rank): the clusters (cluster, key) with most notes among those of which no note was reviewed."""
    touched = clusters.join(reviewed.select("key").distinct(), "key", "left_semi").select("cluster").distinct()
    sizes = clusters.join(touched, "cluster", "left_anti").groupBy("cluster").agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "cluster").limit(top)  # so that the ranks are given to as many rows only
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")))


def refinement(near: DataFrame, notes: DataFrame, low: float = 0.74, high: float = 0.92, most: int = 5, excluded: tuple[str, ...] = (), literature: str = "literature", nearest: int = 10) -> DataFrame:
    """(id, note, other, cosine, n): the closest partners of each note, at most so many, whose cosine lies in the band, numbered throughout.

    near: a, b, similarity, all pairs from low on, or note, other, similarity,
    each note's nearest few of them (``vectors.nearest``). notes: key, name,
    folder, is_new. Only a note's nearest few are looked at; of these partners of
    one name, two new notes, notes of excluded folders, and two notes of
    literature are left out.
    """
    every = near.where(F.col("similarity") >= low)
    if "note" in near.columns:
        ways = every.select("note", "other", "similarity")
    else:
        ways = every.select(F.col("a").alias("note"), F.col("b").alias("other"), "similarity").unionByName(every.select(F.col("b").alias("note"), F.col("a").alias("other"), "similarity"))
    order = Window.partitionBy("note").orderBy(F.desc("similarity"), "other")
    ways = ways.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest).drop("n")
    info = notes.select("key", "name", "folder", "is_new").where(~F.col("folder").isin(list(excluded)))
    left, right = (info.select(*[F.col(c).alias(f"{p}_{c}") for c in info.columns]) for p in ("x", "y"))
    band = ways.where(F.col("similarity") <= high).join(left, F.col("note") == F.col("x_key")).join(right, F.col("other") == F.col("y_key"))
    both_lit = (F.col("x_folder") == literature) & (F.col("y_folder") == literature)
    kept = band.where((F.col("x_name") != F.col("y_name")) & ~(F.col("x_is_new") & F.col("y_is_new")) & ~both_lit).select("note", "other", "similarity")
    best = kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("note", "other", F.round("similarity", 6).alias("cosine"), "n")
    # written: numbering reads it twice
    return numbered(written(best, "refinement"), F.asc("note"), F.asc("n"), name="id")
