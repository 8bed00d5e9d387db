"""Sessions from gaps that the data choose, project phases and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP_MINUTES = 480
SEARCH = (15, 120)
SMOOTH = 10
DEFAULT_MINUTES = 30


def gaps(events: DataFrame, by: str, at: str) -> DataFrame:
    """events with ``gap``: minutes since the one before of the same group (null for the first)."""
    order = Window.partitionBy(by).orderBy(at, *[c for c in ("event_id", "key") if c in events.columns])
    return events.withColumn("gap", (F.col(at) - F.lag(at).over(order)) / 60.0)


def threshold_minutes(with_gaps: DataFrame) -> DataFrame:
    """One row (threshold): the emptiest smoothed minute of the gap histogram from 15 to 120, the first of several."""
    spark = with_gaps.sparkSession
    minute = F.least(F.floor(F.greatest(F.col("gap"), F.lit(0.0))), F.lit(CAP_MINUTES)).cast("int")
    seen = with_gaps.where("gap IS NOT NULL").groupBy(minute.alias("minute")).agg(F.count("*").alias("n"))
    # 481 rows whatever the input, so one window over them is no burden
    bins = spark.range(CAP_MINUTES + 1).select(F.col("id").cast("int").alias("minute")).join(F.broadcast(seen), "minute", "left").na.fill(0, ["n"])
    smooth = bins.withColumn("smooth", F.avg("n").over(Window.orderBy("minute").rowsBetween(-SMOOTH, SMOOTH)))
    best = smooth.where(F.col("minute").between(*SEARCH)).agg(F.min(F.struct("smooth", "minute")).alias("b"), F.sum("n").alias("_"))
    return best.crossJoin(seen.agg(F.sum("n").alias("total"))).select(F.when(F.coalesce("total", F.lit(0)) == 0, DEFAULT_MINUTES).otherwise(F.col("b.minute")).alias("threshold"))


def assign(with_gaps: DataFrame, by: str, at: str, threshold: DataFrame) -> DataFrame:
    """session_id from 0 within each group: one more wherever the gap exceeds the threshold."""
    order = Window.partitionBy(by).orderBy(at, *[c for c in ("event_id", "key") if c in with_gaps.columns]).rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("gap") > F.col("threshold"), 1).otherwise(0)
    return with_gaps.crossJoin(F.broadcast(threshold)).withColumn("session_id", F.sum(new).over(order)).drop("threshold")


def summaries(sessions: DataFrame, by: list[str], at: str, title: str, least: int = 2, samples: int = 3) -> DataFrame:
    """Per session count, first and last time and the first titles; sessions of fewer than least are dropped."""
    order = Window.partitionBy(*by).orderBy(F.col(title).isNull(), at, title)
    sessions = sessions.withColumn("_n", F.row_number().over(order))
    first = F.transform(F.array_sort(F.collect_list(F.when((F.col("_n") <= samples) & F.col(title).isNotNull(), F.struct("_n", title)))), lambda x: x[title])
    return sessions.groupBy(*by).agg(F.count("*").alias("note_count"), F.min(at).alias("first_mtime"), F.max(at).alias("last_mtime"), first.alias("sample_titles")).where(F.col("note_count") >= least)


def phases(tagged: DataFrame, at: str, least: int = 3) -> DataFrame:
    """Per tag in lower case first and last time and count; tags of fewer than least are dropped."""
    return tagged.groupBy(F.lower("tag").alias("tag")).agg(F.min(at).alias("first_mtime"), F.max(at).alias("last_mtime"), F.count("*").alias("note_count")).where(F.col("note_count") >= least)


def epoch(ts: str) -> Column:
    """Seconds of a timestamp without zone, taken as UTC, with their fraction."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
