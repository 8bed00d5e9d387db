"""Queries over the event log, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkatlas.operators import evaluate, fusion, reports, sessions
from sparkatlas.plans import adapters as A
from sparkatlas.plans.registry import query, table

GAPS_SQL = f"WITH {A.LOG_SQL}, g AS (SELECT *, (sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id)) / 60.0 AS gap FROM log)"
THRESHOLD_SQL = f"""{GAPS_SQL},
h AS (SELECT least(floor(greatest(gap, 0.0)), 480)::INT AS minute, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1),
b AS (SELECT r.minute, coalesce(n, 0) AS n FROM (SELECT unnest(range(481))::INT AS minute) r LEFT JOIN h USING (minute)),
s AS (SELECT minute, avg(n) OVER (ORDER BY minute ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS smooth FROM b),
t AS (SELECT minute AS threshold FROM s WHERE minute BETWEEN 15 AND 120 ORDER BY smooth, minute LIMIT 1)"""
SESSIONS_SQL = f"""{THRESHOLD_SQL},
sess AS (SELECT *, sum(CASE WHEN gap > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_id FROM g, t)"""


@query("session_threshold", f"{THRESHOLD_SQL} SELECT threshold FROM t")
def session_threshold(spark, d):
    return sessions.threshold_minutes(sessions.gaps(A.log(spark, d), "user_id", "sec"))


def _sessions(spark, d):
    g = sessions.gaps(A.log(spark, d), "user_id", "sec")
    return sessions.assign(g, "user_id", "sec", sessions.threshold_minutes(g))


@query("session_assign", f"{SESSIONS_SQL} SELECT event_id, user_id, session_id FROM sess")
def session_assign(spark, d):
    return _sessions(spark, d).select("event_id", "user_id", "session_id")


@query(
    "session_summary",
    f"""{SESSIONS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY sec, event_type) AS n FROM sess)
SELECT user_id, session_id, count(*) AS note_count, round(min(sec), 3) AS first_mtime, round(max(sec), 3) AS last_mtime, string_agg(CASE WHEN n <= 3 THEN event_type END, ',' ORDER BY n) AS sample_titles
FROM r GROUP BY user_id, session_id HAVING count(*) >= 2""",
)
def session_summary(spark, d):
    out = sessions.summaries(_sessions(spark, d), ["user_id", "session_id"], "sec", "event_type")
    return out.select("user_id", "session_id", "note_count", F.round("first_mtime", 3).alias("first_mtime"), F.round("last_mtime", 3).alias("last_mtime"), F.array_join("sample_titles", ",").alias("sample_titles"))


@query("project_phases", f"WITH {A.LOG_SQL} SELECT lower(event_type) AS tag, round(min(sec), 3) AS first_mtime, round(max(sec), 3) AS last_mtime, count(*) AS note_count FROM log GROUP BY 1 HAVING count(*) >= 3")
def project_phases(spark, d):
    out = sessions.phases(A.log(spark, d).withColumn("tag", F.col("event_type")), "sec")
    return out.select("tag", F.round("first_mtime", 3).alias("first_mtime"), F.round("last_mtime", 3).alias("last_mtime"), "note_count")


@query(
    "phase_boost",
    f"""WITH {A.LOG_SQL} SELECT event_id, round(value * (1 + 0.15 * (exp(-((sec - 1705276800.0) * (sec - 1705276800.0)) / (2 * 216000.0 * 216000.0)) - 0.5)), 6) AS score FROM log""",
)
def phase_boost(spark, d):
    start, end = 1705276800.0 - 432000, 1705276800.0 + 432000
    return A.log(spark, d).select("event_id", F.round(F.col("value") * fusion.phase_factor(F.col("sec"), start, end), 6).alias("score"))


@query("recency_decay", f"WITH {A.LOG_SQL} SELECT event_id, round(value * exp(-ln(2.0) * greatest(0.0, 1706745600.0 - sec) / (14 * 86400.0)), 6) AS score FROM log")
def recency_decay(spark, d):
    return A.log(spark, d).select("event_id", F.round(F.col("value") * fusion.recency_factor(F.col("sec"), A.NOW, 14), 6).alias("score"))


@query("time_range_filter", f"WITH {A.LOG_SQL} SELECT event_id, user_id FROM log WHERE sec IS NULL OR (sec >= 1704672000.0 AND sec <= 1705276800.0)")
def time_range_filter(spark, d):
    sec = F.col("sec")
    return A.log(spark, d).where(sec.isNull() | sec.between(1704672000.0, 1705276800.0)).select("event_id", "user_id")


@query(
    "daily_rollup",
    f"""WITH {A.LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS actor, count(DISTINCT user_id) AS n_sessions,
    count(*) FILTER (WHERE k % 3 = 0) AS n_write, count(*) FILTER (WHERE k % 3 = 1) AS n_fix, count(*) FILTER (WHERE k % 3 = 2) AS n_promote FROM log GROUP BY 1, 2""",
)
def daily_rollup(spark, d):
    k = F.col("k") % 3
    return reports.daily_rollup(A.log(spark, d), F.date_format("ts", "yyyy-MM-dd"), F.col("event_type"), "user_id", {"n_write": k == 0, "n_fix": k == 1, "n_promote": k == 2})


@query(
    "daily_consolidation",
    f"""WITH {A.LOG_SQL}, e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN k % 10 > 0 THEN user_id END AS s, CASE WHEN event_type = 'view' THEN 'search' END AS skill, CASE WHEN k % 4 = 0 THEN 'librarian' ELSE '' END AS agent,
  CASE event_type WHEN 'purchase' THEN 'vault-write' WHEN 'click' THEN 'fix' WHEN 'error' THEN 'verify-fix' WHEN 'signup' THEN 'promote' END AS action FROM log WHERE k <> 50),
a AS (SELECT *, coalesce(skill, nullif(agent, ''), action, 'unknown') AS actor FROM e), d AS (SELECT day, count(DISTINCT s) AS total_sessions FROM a GROUP BY day)
SELECT day, any_value(total_sessions) AS total_sessions, actor, count(DISTINCT s) AS sessions, count(*) FILTER (WHERE action = 'vault-write') AS notes_created, count(*) FILTER (WHERE action IN ('fix', 'verify-fix')) AS fixes, count(*) FILTER (WHERE action = 'promote') AS promotions FROM a JOIN d USING (day) GROUP BY day, actor""",
)
def daily_consolidation(spark, d):
    """The log's events as those of skills, agents and actions; some have no session, some no time."""
    kind, k = F.col("event_type"), F.col("k")
    action = F.when(kind == "purchase", "vault-write").when(kind == "click", "fix").when(kind == "error", "verify-fix").when(kind == "signup", "promote")
    events = A.log(spark, d).select(
        F.when(k == 50, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("ts"),
        F.when(k % 10 > 0, F.col("user_id").cast("string")).otherwise("").alias("session_id"),
        F.when(kind == "view", "search").alias("skill"),
        F.when(k % 4 == 0, "librarian").otherwise("").alias("agent"),
        action.alias("action"),
    )
    return reports.consolidation(events)


FINDINGS_SQL = """f AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS n_ambiguous FROM labels JOIN documents USING (doc_id) WHERE quality = 0 GROUP BY source)"""


def _findings(spark, d):
    scores = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return reports.findings_by(scores, "source", F.col("quality") == 0, F.col("toxic") == 1)


@query("findings_by_type", f"WITH {FINDINGS_SQL} SELECT source, n, n_ambiguous, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM f")
def findings_by_type(spark, d):
    return _findings(spark, d)


@query("taxonomy_advice", f"WITH {FINDINGS_SQL} SELECT source, n, n_ambiguous, CASE WHEN n >= 3 AND n_ambiguous > 0.3 * n THEN 'split' WHEN n <= 1 AND (SELECT sum(n) FROM f) > 20 THEN 'merge' END AS advice FROM f")
def taxonomy_advice(spark, d):
    return reports.taxonomy_advice(_findings(spark, d), "source")


@query(
    "config_rate",
    f"""WITH {A.LOG_SQL},
c AS (SELECT user_id, event_type AS config FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC) AS n FROM log) WHERE n = 1),
w AS (SELECT k AS note, user_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sec DESC) AS n FROM log) WHERE n = 1),
s AS (SELECT doc_id AS note, max(1 - quality) AS flagged FROM labels GROUP BY doc_id)
SELECT config, count(*) AS total, sum(flagged)::BIGINT AS flagged FROM w JOIN c USING (user_id) JOIN s USING (note) GROUP BY config""",
)
def config_rate(spark, d):
    log = A.log(spark, d)
    starts = log.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("config"), F.col("sec").alias("ts"))
    writes = log.select(F.col("k").alias("note"), F.col("user_id").alias("session_id"), F.col("sec").alias("ts"))
    scores = table(spark, d, "labels").select(F.col("doc_id").alias("note"), (F.col("quality") == 0).alias("flagged"))
    return reports.finding_rate(starts, writes, scores)


@query("unverified_backlog", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unverified_backlog(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("distinct_volumes", f"WITH {A.LOG_SQL} SELECT count(DISTINCT user_id) AS n_sessions, count(DISTINCT k) AS n_notes, (SELECT count(DISTINCT doc_id) FROM labels) AS n_scored FROM log")
def distinct_volumes(spark, d):
    a = A.log(spark, d).agg(F.countDistinct("user_id").alias("n_sessions"), F.countDistinct("k").alias("n_notes"))
    return a.crossJoin(table(spark, d, "labels").agg(F.countDistinct("doc_id").alias("n_scored")))


@query("retrieval_top_queries", f"WITH {A.LOG_SQL} SELECT value, count(*) AS n FROM (SELECT lower(trim(event_type || ' ' || k)) AS value FROM log) GROUP BY value ORDER BY n DESC, value LIMIT 10")
def retrieval_top_queries(spark, d):
    from sparkatlas.functions.text import normalise_query

    return reports.top_values(A.log(spark, d), normalise_query(F.concat_ws(" ", "event_type", "k")), 10)


@query(
    "floor_percentiles",
    f"""WITH {A.LOG_SQL}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM log WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (WHERE i = floor(50 * (n - 1) / 100)) AS p50, max(value) FILTER (WHERE i = floor(90 * (n - 1) / 100)) AS p90, max(value) FILTER (WHERE i = floor(99 * (n - 1) / 100)) AS p99 FROM r GROUP BY event_type""",
)
def floor_percentiles(spark, d):
    return reports.floor_percentiles(A.log(spark, d), "event_type", "value")


CACHE_SQL = f"WITH {A.LOG_SQL}, c AS (SELECT *, CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS hit, k % 7 AS made, k % 5 AS raw FROM log)"


def _cache(spark, d):
    k = F.col("k")
    return A.log(spark, d).select("*", F.when(k % 4 == 0, 0).otherwise(k).alias("hit"), (k % 7).alias("made"), (k % 5).alias("raw"))


@query("weighted_hit_rate", f"{CACHE_SQL} SELECT event_type, count(*) AS n, round(sum(hit) / nullif(sum(hit) + sum(made) + sum(raw), 0), 6) AS rate, count(*) FILTER (WHERE hit = 0) AS n_zero FROM c GROUP BY event_type")
def weighted_hit_rate(spark, d):
    return reports.hit_rate(_cache(spark, d), "event_type", "hit", ["made", "raw"])


@query(
    "rolling_hit_rate",
    f"""{CACHE_SQL}, t AS (SELECT event_id, user_id, hit, hit + made + raw AS total, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS turn,
  sum(hit) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS lifetime_hit, sum(hit + made + raw) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS lifetime_all FROM c),
b AS (SELECT *, sum(CASE WHEN turn > 5 AND hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS busts FROM t),
w AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h, sum(total) OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a FROM b WHERE turn > 5)
SELECT event_id, turn, lifetime_hit, lifetime_all, busts, round(CASE WHEN a > 0 THEN h / a ELSE 1.0 END, 6) AS window_rate FROM w""",
)
def rolling_hit_rate(spark, d):
    total = F.col("hit") + F.col("made") + F.col("raw")
    out = reports.rolling_hit_rate(_cache(spark, d), "user_id", ["sec", "event_id"], F.col("hit"), total)
    return out.select("event_id", F.col("turn").cast("long").alias("turn"), "lifetime_hit", "lifetime_all", "busts", F.round("window_rate", 6).alias("window_rate"))


@query(
    "consecutive_dedupe",
    f"""WITH {A.LOG_SQL}, b AS (SELECT *, lag(event_type) OVER w AS pe, lag(k % 3) OVER w AS pk, row_number() OVER w AS n FROM log WINDOW w AS (ORDER BY sec, event_id))
SELECT event_id, user_id, event_type FROM b WHERE n = 1 OR pe IS DISTINCT FROM event_type OR pk IS DISTINCT FROM k % 3""",
)
def consecutive_dedupe(spark, d):
    log = A.log(spark, d).withColumn("m", F.col("k") % 3)
    day = F.floor(F.col("sec") / 86400)
    return reports.drop_consecutive(log, ["sec", "event_id"], ["event_type", "m"], day).select("event_id", "user_id", "event_type")


@query("score_histogram", f"WITH {A.LOG_SQL} SELECT event_type, least(floor(k / 100.0 * 10), 9)::INT AS bin, count(*) AS n FROM log GROUP BY 1, 2")
def score_histogram(spark, d):
    return reports.score_histogram(A.log(spark, d), F.col("k") / 100.0, "event_type")


@query(
    "recency_label",
    """WITH w AS (SELECT conv_id, CASE WHEN length(text) % 3 = 0 THEN 'write' WHEN length(text) % 3 = 1 THEN 'search' ELSE 'fix' END AS label,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, label, sum(CASE WHEN back = 1 THEN 10 WHEN back <= 4 THEN 3 ELSE 1 END)::BIGINT AS score FROM w GROUP BY 1, 2)
SELECT * FROM (SELECT conv_id, label, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, label) AS rank FROM s) WHERE rank <= 2""",
)
def recency_label(spark, d):
    n = F.length("text") % 3
    said = table(spark, d, "conversations").where("role = 'user'").withColumn("label", F.when(n == 0, "write").when(n == 1, "search").when(n == 2, "fix").otherwise("fix"))
    return reports.top_weighted(reports.label_weights(said, "conv_id", "turn"), "conv_id", "label", 2)


@query("classifier_precision", "SELECT lang, toxic, count(*) AS n, round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS strict, round(count(*) FILTER (WHERE quality = 1 OR n_chars > 2000) / count(*), 6) AS loose FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def classifier_precision(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return evaluate.classifier_precision(joined, ["lang", "toxic"], F.col("quality") == 1, F.col("n_chars") > 2000)


@query("citation_conflicts", "SELECT text, count(DISTINCT source) AS n_sources FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) > 1")
def citation_conflicts(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy("text").agg(F.countDistinct("source").alias("n_sources")).where("n_sources > 1")


@query(
    "ema_novelty",
    f"""WITH RECURSIVE {A.LOG_SQL}, r AS (SELECT user_id, k / 100.0 AS x, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS n FROM log),
e AS (SELECT user_id, n, x AS ema FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.n, CASE WHEN r.n = 2 THEN (e.ema + r.x) / 2 ELSE 0.3 * r.x + 0.7 * e.ema END FROM e JOIN r ON r.user_id = e.user_id AND r.n = e.n + 1 WHERE r.n <= 12)
SELECT user_id, max(n) AS n, round(max_by(ema, n), 6) AS ema FROM e GROUP BY user_id""",
)
def ema_novelty(spark, d):
    """Running mean of the first 12 rates per user: the query budget of a research session."""
    from sparkatlas.streaming.convergence import ema

    return ema(A.log(spark, d).select("user_id", "sec", "event_id", (F.col("k") / 100.0).alias("rate")), "user_id", ["sec", "event_id"], "rate", 12).withColumn("ema", F.round("ema", 6))


@query(
    "retrieval_report",
    f"""WITH {A.LOG_SQL}, r AS (SELECT event_type AS command, ' Q' || (k % 37) AS query, [k, k + 1] AS paths, 'f' || (event_id % 41) AS file, user_id % 7 AS peer, user_id AS session FROM log),
q AS (SELECT lower(trim(query)) AS value, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, value LIMIT 10),
p AS (SELECT value, count(*) AS n FROM (SELECT unnest(paths) AS value FROM r) GROUP BY 1 ORDER BY n DESC, value LIMIT 10),
f AS (SELECT file AS value, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, value LIMIT 15)
SELECT 'command' AS kind, command AS value, count(*) AS n FROM r GROUP BY command UNION ALL SELECT 'query', value, n FROM q UNION ALL SELECT 'path', value::VARCHAR, n FROM p
UNION ALL SELECT 'file', value, n FROM f UNION ALL SELECT 'peers', 'all', count(DISTINCT peer) FROM r UNION ALL SELECT 'sessions', 'all', count(DISTINCT session) FROM r""",
)
def retrieval_report(spark, d):
    k = F.col("k")
    log = A.log(spark, d).select(F.col("event_type").alias("command"), F.concat(F.lit(" Q"), k % 37).alias("query"), F.array(k, k + 1).alias("paths"), F.concat(F.lit("f"), F.col("event_id") % 41).alias("file"), (F.col("user_id") % 7).alias("peer"), F.col("user_id").alias("session"))
    return reports.retrieval_report(log)


@query("session_last_cost", f"WITH {A.LOG_SQL} SELECT user_id AS session, value AS cost FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS n FROM log) WHERE n = 1")
def session_last_cost(spark, d):
    turns = A.log(spark, d).withColumn("at", F.struct("sec", "event_id"))
    return reports.last_cost(turns, "user_id", "value", "at").select(F.col("user_id").alias("session"), "cost")


@query(
    "shadow_review",
    f"""WITH {A.LOG_SQL}, s AS (SELECT k % 11 = 0 AS skipped, k >= 35 AS passed, CASE WHEN k % 13 = 0 THEN 'no answer' END AS a, CASE WHEN k % 17 = 0 THEN 'timeout' END AS b FROM log),
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE skipped) AS skips, count(*) FILTER (WHERE a IS NULL) AS first_ok, count(*) FILTER (WHERE b IS NULL) AS second_ok,
      count(*) FILTER (WHERE NOT skipped AND a IS NULL AND b IS NULL) AS healthy, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE passed AND NOT skipped AND a IS NULL AND b IS NULL) AS passed_healthy FROM s)
SELECT *, round(passed_healthy / healthy, 6) AS pass_rate, CASE WHEN least(first_ok, second_ok) / total < 0.6 AND total >= 50 THEN 'infrastructure' WHEN healthy < 100 THEN 'not_ready' WHEN passed_healthy >= 20 AND passed_healthy / healthy >= 0.05 THEN 'ready'
       WHEN healthy >= 300 AND passed_healthy / healthy < 0.02 THEN 'too_strict' ELSE 'inconclusive' END AS verdict FROM t""",
)
def shadow_review(spark, d):
    k = F.col("k")
    return reports.shadow_review(A.log(spark, d).select((k % 11 == 0).alias("skipped"), (k >= 35).alias("passed"), F.when(k % 13 == 0, "no answer").alias("first_error"), F.when(k % 17 == 0, "timeout").alias("second_error")))


SHADOW_SQL = f"""{A.LOG_SQL}, s AS (SELECT event_id AS entry, user_id % 5 AS grp, k % 11 = 0 AS skipped, CASE user_id % 5 WHEN 2 THEN false WHEN 4 THEN k % 33 = 1 ELSE k >= 35 END AS passed,
  CASE WHEN k % 13 = 0 OR user_id % 5 = 1 AND k % 2 = 0 THEN 'no answer' END AS a, CASE WHEN k % 17 = 0 THEN 'timeout' END AS b, k * 7 % 300 + 0.5 AS first_ms, CASE WHEN k % 3 > 0 THEN k * 11 % 500 + 0.25 END AS second_ms,
  k / 100.0 AS first_score, event_id % 97 / 97.0 AS second_score FROM log WHERE user_id % 5 <> 3 OR event_id % 40 = 0)"""


def _shadow(spark, d):
    """The log as entries of a shadow gate, in five groups that fare differently."""
    k, g = F.col("k"), F.col("user_id") % 5
    passed = F.when(g == 2, False).when(g == 4, k % 33 == 1).otherwise(k >= 35)
    return A.log(spark, d).where((g != 3) | (F.col("event_id") % 40 == 0)).select(
        F.col("event_id").alias("entry"), g.alias("grp"), (k % 11 == 0).alias("skipped"), passed.alias("passed"),
        F.when((k % 13 == 0) | ((g == 1) & (k % 2 == 0)), "no answer").alias("first_error"), F.when(k % 17 == 0, "timeout").alias("second_error"),
        (k * 7 % 300 + 0.5).cast("double").alias("first_ms"), F.when(k % 3 > 0, k * 11 % 500 + 0.25).cast("double").alias("second_ms"),
        (k / 100.0).alias("first_score"), (F.col("event_id") % 97 / 97.0).alias("second_score"),
    )


@query(
    "shadow_verdicts",
    f"""WITH {SHADOW_SQL}, t AS (SELECT grp, count(*) AS total, least(count(*) FILTER (WHERE a IS NULL), count(*) FILTER (WHERE b IS NULL)) AS ok, count(*) FILTER (WHERE NOT skipped AND a IS NULL AND b IS NULL) AS healthy,
  count(*) FILTER (WHERE passed AND NOT skipped AND a IS NULL AND b IS NULL) AS passed_healthy FROM s GROUP BY grp)
SELECT grp, total, healthy, passed_healthy, CASE WHEN ok / total < 0.6 AND total >= 50 THEN 'infrastructure' WHEN healthy < 100 THEN 'not_ready' WHEN passed_healthy >= 20 AND passed_healthy / healthy >= 0.05 THEN 'ready'
  WHEN healthy >= 300 AND passed_healthy / healthy < 0.02 THEN 'too_strict' ELSE 'inconclusive' END AS verdict FROM t""",
)
def shadow_verdicts(spark, d):
    return reports.shadow_review(_shadow(spark, d), ("grp",)).select("grp", "total", "healthy", "passed_healthy", "verdict")


@query(
    "shadow_latencies",
    f"""WITH {SHADOW_SQL}, h AS (SELECT * FROM s WHERE NOT skipped AND a IS NULL AND b IS NULL), l AS (SELECT 'first' AS backend, first_ms AS ms FROM h UNION ALL SELECT 'second', second_ms FROM h),
o AS (SELECT backend, list(ms ORDER BY ms) FILTER (WHERE ms IS NOT NULL) AS m FROM l GROUP BY backend)
SELECT backend, m[floor(0.5 * (len(m) - 1))::INT + 1]::DOUBLE AS p50, m[floor(0.95 * (len(m) - 1))::INT + 1]::DOUBLE AS p95, m[len(m)]::DOUBLE AS most FROM o""",
)
def shadow_latencies(spark, d):
    return reports.shadow_latencies(_shadow(spark, d))


@query("shadow_passes", f"WITH {SHADOW_SQL} SELECT entry, round(greatest(first_score, second_score), 6) AS best, row_number() OVER (ORDER BY greatest(first_score, second_score) DESC, entry) AS rank FROM s WHERE passed AND NOT skipped AND a IS NULL AND b IS NULL ORDER BY rank LIMIT 20")
def shadow_passes(spark, d):
    return reports.shadow_passes(_shadow(spark, d)).withColumn("best", F.round("best", 6))


@query(
    "session_label",
    """WITH w AS (SELECT conv_id, chr(97 + (length(text) % 5)::INT) || ' topic of some length' AS topic, CASE WHEN length(text) % 2 = 0 THEN 'write' ELSE 'fix' END AS action,
    CASE row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) WHEN 1 THEN 10 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 1 END AS w FROM conversations WHERE role = 'user' AND text IS NOT NULL),
t AS (SELECT conv_id, topic, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, topic) AS r FROM (SELECT conv_id, topic, sum(w) AS s FROM w GROUP BY 1, 2)),
a AS (SELECT conv_id, action, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, action) AS r FROM (SELECT conv_id, action, sum(w) AS s FROM w GROUP BY 1, 2)),
j AS (SELECT t.conv_id, string_agg(topic, ' ' ORDER BY t.r) || ' ' || any_value(action) AS label FROM t JOIN a ON a.conv_id = t.conv_id AND a.r = 1 WHERE t.r <= 2 GROUP BY t.conv_id)
SELECT conv_id, CASE WHEN length(label) > 35 THEN substr(label, 1, 34) || '…' ELSE label END AS label FROM j""",
)
def session_label(spark, d):
    n = F.length("text")
    said = table(spark, d, "conversations").where("role = 'user' AND text IS NOT NULL")
    weighed = reports.label_weights(said, "conv_id", "turn")
    topic = F.concat(F.char((n % 5 + 97).cast("long")), F.lit(" topic of some length"))
    by = lambda c, top: reports.top_weighted(weighed.withColumn("label", c), "conv_id", "label", top)
    return reports.session_label(by(topic, 2), by(F.when(n % 2 == 0, "write").otherwise("fix"), 1), "conv_id")


@query(
    "config_ratio",
    f"""WITH {A.LOG_SQL}, c AS (SELECT event_type AS config, count(*) AS total, count(*) FILTER (WHERE k % 10 < length(event_type) - 3) AS flagged FROM log GROUP BY 1), r AS (SELECT config, flagged / total AS rate FROM c WHERE total >= 5),
l AS (SELECT config AS other, rate AS low FROM r WHERE rate > 0 ORDER BY rate, config LIMIT 1) SELECT config, other, round(rate / low, 6) AS ratio FROM r, l WHERE rate >= 2 * low""",
)
def config_ratio(spark, d):
    flagged = F.sum(F.when(F.col("k") % 10 < F.length("event_type") - 3, 1).otherwise(0)).alias("flagged")
    return reports.config_ratio(A.log(spark, d).groupBy(F.col("event_type").alias("config")).agg(F.count("*").alias("total"), flagged))
