"""Reports over event logs: findings, configurations, daily rollups, retrieval, caches, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def findings_by(scores: DataFrame, key: str, failed: Column, ambiguous: Column) -> DataFrame:
    """Failed scores per key: count, ambiguous ones, and their share of all failed ones in percent."""
    bad = scores.where(failed).groupBy(key).agg(F.count("*").alias("n"), F.sum(F.when(ambiguous, 1).otherwise(0)).alias("n_ambiguous"))
    total = bad.agg(F.sum("n").alias("total"))
    return bad.crossJoin(F.broadcast(total)).select(key, "n", "n_ambiguous", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


def taxonomy_advice(findings: DataFrame, key: str) -> DataFrame:
    """Types to split (three or more, over 30 % ambiguous) and to merge (at most one of over twenty)."""
    total = findings.agg(F.sum("n").alias("total"))
    advice = F.when((F.col("n") >= 3) & (F.col("n_ambiguous") > 0.3 * F.col("n")), "split").when((F.col("n") <= 1) & (F.col("total") > 20), "merge")
    return findings.crossJoin(F.broadcast(total)).select(key, "n", "n_ambiguous", advice.alias("advice"))


def last_by(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The value of the last row per key: last write wins."""
    return df.groupBy(key).agg(F.max_by(value, at).alias(value))


def finding_rate(starts: DataFrame, writes: DataFrame, scores: DataFrame) -> DataFrame:
    """Notes per configuration, total and flagged.

    starts: session_id, config, ts. writes: note, session_id, ts. scores: note, flagged.
    """
    config = last_by(starts, "session_id", "config", "ts")
    of_note = last_by(writes, "note", "session_id", "ts").join(config, "session_id")
    flagged = scores.groupBy("note").agg(F.max(F.col("flagged").cast("int")).alias("flagged"))
    return of_note.join(flagged, "note").groupBy("config").agg(F.count("*").alias("total"), F.sum("flagged").alias("flagged"))


def daily_rollup(events: DataFrame, day: Column, actor: Column, session: str, counted: dict[str, Column]) -> DataFrame:
    """Per day and actor the distinct sessions and counts of the named conditions."""
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in counted.items()]
    return events.groupBy(day.alias("day"), actor.alias("actor")).agg(F.countDistinct(session).alias("n_sessions"), *sums)


def consolidation(events: DataFrame) -> DataFrame:
    """(day, total_sessions, actor, sessions, notes_created, fixes, promotions) of a log (ts as ISO text, session_id, skill, agent, action).

    An event is its skill's, else its agent's, else its action's; blank ones
    count as missing. Events without a time are left out.
    """
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = events.where("ts <> ''").select(F.substring("ts", 1, 10).alias("day"), given("session_id").alias("session_id"), F.coalesce(given("skill"), given("agent"), given("action"), F.lit("unknown")).alias("actor"), "action")
    n = lambda *actions: F.sum(F.when(F.col("action").isin(*actions), 1).otherwise(0))
    by = rows.groupBy("day", "actor").agg(F.countDistinct("session_id").alias("sessions"), n("vault-write").alias("notes_created"), n("fix", "verify-fix").alias("fixes"), n("promote").alias("promotions"))
    days = rows.groupBy("day").agg(F.countDistinct("session_id").alias("total_sessions"))
    return by.join(days, "day").select("day", "total_sessions", "actor", "sessions", "notes_created", "fixes", "promotions")


def top_values(df: DataFrame, value: Column, top: int, name: str = "value") -> DataFrame:
    """The most frequent values; ties go by the value."""
    counts = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), name).limit(top)


def floor_percentiles(df: DataFrame, key: str, value: str, points: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """sorted[floor(p / 100 * (n - 1))] per key.

    Equal values are counted before anything is shuffled, so what is put in
    order per key is its distinct values, not its rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    total = counts.groupBy(key).agg(F.sum("c").alias("n"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("last", F.sum("c").over(upto) - 1).join(total, key)
    at = lambda p: F.floor(F.lit(p) * (F.col("n") - 1) / 100)
    pick = lambda p: F.max(F.when((F.col("last") >= at(p)) & (F.col("last") - F.col("c") < at(p)), F.col(value)))
    return ranked.groupBy(key).agg(*[pick(p).alias(f"p{p}") for p in points])


def hit_rate(df: DataFrame, key: str | None, hit: str, miss: list[str]) -> DataFrame:
    """Weighted rate: all hits over all hits and misses; null without any."""
    total = F.sum(F.col(hit)) + sum((F.sum(F.col(m)) for m in miss), F.lit(0.0))
    agg = (F.count("*").alias("n"), F.round(F.sum(hit) / F.when(total != 0, total), 6).alias("rate"), F.sum(F.when(F.col(hit) == 0, 1).otherwise(0)).alias("n_zero"))
    return df.groupBy(key).agg(*agg) if key else df.agg(*agg)


def rolling_hit_rate(df: DataFrame, key: str, order: list[str], hit: Column, total: Column, warm_up: int = 5, width: int = 10) -> DataFrame:
    """After the first turns, the rate over the last ten of them, and running sums over all (busts: turns after the first that hit nothing)."""
    w = Window.partitionBy(key).orderBy(*order)
    turns = df.withColumn("turn", F.row_number().over(w)).withColumn("_hit", hit).withColumn("_all", total)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    bust = F.when((F.col("turn") > warm_up) & (F.col("_hit") == 0), 1).otherwise(0)
    late = turns.withColumn("lifetime_hit", F.sum("_hit").over(so_far)).withColumn("lifetime_all", F.sum("_all").over(so_far)).withColumn("busts", F.sum(bust).over(so_far)).where(F.col("turn") > warm_up)
    recent = w.rowsBetween(-(width - 1), 0)
    hits, alls = F.sum("_hit").over(recent), F.sum("_all").over(recent)
    return late.withColumn("window_rate", F.when(alls > 0, hits / alls).otherwise(1.0)).drop("_hit", "_all")


def drop_consecutive(df: DataFrame, order: list[str], same: list[str], bucket: Column) -> DataFrame:
    """Without rows whose values equal those of the row just before, over the whole log.

    bucket: a coarse part of the order (a day), so that no task holds the whole
    log; each bucket's first row is compared with the last row of the bucket before.
    """
    state = F.struct(*same)
    rows = df.withColumn("_bucket", bucket).withColumn("_state", state)
    within = Window.partitionBy("_bucket").orderBy(*order)
    ends = rows.groupBy("_bucket").agg(F.max_by("_state", F.struct(*order)).alias("_end"))
    before = ends.select("_bucket", F.lag("_end").over(Window.orderBy("_bucket")).alias("_carry"))  # one row a bucket
    rows = rows.join(before, "_bucket").withColumn("_n", F.row_number().over(within)).withColumn("_lag", F.lag("_state").over(within))
    last = F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return rows.where(~F.col("_state").eqNullSafe(last)).drop("_bucket", "_state", "_carry", "_n", "_lag")


def score_histogram(df: DataFrame, score: Column, key: str | None = None) -> DataFrame:
    """Scores in ten bins of a tenth, the last one open."""
    level = F.least(F.floor(score * 10), F.lit(9)).cast("int").alias("bin")
    return df.groupBy(*([key] if key else []), level).agg(F.count("*").alias("n"))


def label_weights(df: DataFrame, by: str, order: str) -> DataFrame:
    """Recency weight of each message: 10 for the last, 3 for the three before, 1 for older ones."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    back = F.row_number().over(w)
    return df.withColumn("weight", F.when(back == 1, 10).when(back <= 4, 3).otherwise(1))


def top_weighted(df: DataFrame, by: str, label: str, top: int) -> DataFrame:
    """The labels of most weight per group; ties go by the label."""
    sums = df.groupBy(by, label).agg(F.sum("weight").alias("score"))
    w = Window.partitionBy(by).orderBy(F.desc("score"), label)
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def edge_stats(edges: DataFrame) -> DataFrame:
    """Edges by type, confidence and source graph, and in all."""
    return edges.select(F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("edge_type", "confidence", "source_graph")])).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def session_label(topics: DataFrame, actions: DataFrame, by: str, most: int = 35) -> DataFrame:
    """(by, label): the two topics and the action of most weight, cut to so many characters. topics, actions: as ``top_weighted`` gives them."""
    t = topics.where("rank <= 2").groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), " ").alias("topic"))
    a = actions.where("rank = 1").select(by, F.col("label").alias("action"))
    label = F.trim(F.concat_ws(" ", "topic", "action"))
    return t.join(a, by, "full").select(by, F.when(F.length(label) > most, F.concat(F.substring(label, 1, most - 1), F.lit("…"))).otherwise(label).alias("label"))


def last_cost(turns: DataFrame, session: str, cost: str, at: str) -> DataFrame:
    """The cost that each session reported last."""
    return turns.groupBy(session).agg(F.max_by(cost, at).alias("cost"))


def retrieval_report(log: DataFrame, top: int = 10, top_files: int = 15) -> DataFrame:
    """(kind, value, n): counts of commands, the most frequent queries, surfaced paths and files, and how many peers and sessions.

    log: command, query, paths (array), file, peer, session.
    """
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), F.col("value").cast("string").alias("value"), F.col("n").cast("long").alias("n"))
    some = lambda c: log.where(F.col(c).isNotNull())
    parts = [
        kind(some("command").groupBy(F.col("command").alias("value")).agg(F.count("*").alias("n")), "command"),
        kind(top_values(some("query"), F.lower(F.trim("query")), top), "query"),
        kind(top_values(log.select(F.explode("paths").alias("path")), F.col("path"), top), "path"),
        kind(top_values(some("file"), F.col("file"), top_files), "file"),
        kind(log.agg(F.countDistinct("peer").alias("n")).withColumn("value", F.lit("all")), "peers"),
        kind(log.agg(F.countDistinct("session").alias("n")).withColumn("value", F.lit("all")), "sessions"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shadow_latencies(log: DataFrame) -> DataFrame:
    """(backend, p50, p95, most) of the latencies of healthy entries, by floor index. log: as ``shadow_review``, with first_ms and second_ms."""
    healthy = log.where("NOT skipped AND first_error IS NULL AND second_error IS NULL")
    each = healthy.select(F.explode(F.array(*[F.struct(F.lit(n).alias("backend"), F.col(f"{n}_ms").alias("ms")) for n in ("first", "second")])).alias("x")).select("x.*")
    return floor_percentiles(each, "backend", "ms", (50, 95, 100)).withColumnRenamed("p100", "most")


def shadow_passes(log: DataFrame, top: int = 20) -> DataFrame:
    """(entry, best, rank) of the healthy entries that passed with the best scores. log: as ``shadow_review``, with entry, first_score and second_score."""
    passed = log.where("passed AND NOT skipped AND first_error IS NULL AND second_error IS NULL")
    best = F.greatest(F.coalesce("first_score", F.lit(0.0)), F.coalesce("second_score", F.lit(0.0)))
    first = passed.select("entry", best.alias("best")).orderBy(F.desc("best"), "entry").limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("best"), "entry")))


def shadow_review(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each group): how healthy two backends are, how many entries pass, and what that says about the gate.

    log: skipped, passed (booleans), first_error, second_error (null where the backend answered).
    """
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one, two = F.col("first_error").isNull(), F.col("second_error").isNull()
    healthy = ~F.col("skipped") & one & two
    sums = log.groupBy(*by).agg(F.count("*").alias("total"), n(F.col("skipped")).alias("skips"), n(one).alias("first_ok"), n(two).alias("second_ok"), n(healthy).alias("healthy"), n(F.col("passed")).alias("passed"), n(healthy & F.col("passed")).alias("passed_healthy"))
    rate = F.when(F.col("total") > 0, F.least("first_ok", "second_ok") / F.col("total")).otherwise(0.0)
    share = F.when(F.col("healthy") > 0, F.col("passed_healthy") / F.col("healthy")).otherwise(0.0)
    says = F.when((rate < 0.6) & (F.col("total") >= 50), "infrastructure").when(F.col("healthy") < 100, "not_ready").when((F.col("passed_healthy") >= 20) & (share >= 0.05), "ready").when((F.col("healthy") >= 300) & (share < 0.02), "too_strict").otherwise("inconclusive")
    return sums.select("*", F.round(share, 6).alias("pass_rate"), says.alias("verdict"))


def top_errors(log: DataFrame, error: str, top: int = 3) -> DataFrame:
    """The most frequent errors by their first 60 characters."""
    return top_values(log.where(F.col(error).isNotNull()), F.substring(error, 1, 60), top)


def config_ratio(rates: DataFrame, least: int = 5, ratio: float = 2.0) -> DataFrame:
    """(config, other, ratio): configurations of enough notes that are flagged at least twice as often as another."""
    rate = rates.where(F.col("total") >= least).select("config", (F.col("flagged") / F.col("total")).alias("rate"))
    lowest = rate.where("rate > 0").agg(F.min_by("config", F.struct("rate", "config")).alias("other"), F.min("rate").alias("low"))
    return rate.crossJoin(F.broadcast(lowest)).where(F.col("rate") >= ratio * F.col("low")).select("config", "other", F.round(F.col("rate") / F.col("low"), 6).alias("ratio"))
