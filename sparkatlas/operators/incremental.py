"""Incremental indexing: change classification, upsert, export by tier, edge stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.functions import text as T


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, op): unchanged, mtime, changed, new, deleted or unparsable, from (path, mtime_ms, content_hash).

    A hash of null in new means that the note could not be parsed: its old row stays.
    """
    o = old.select("path", F.col("mtime_ms").alias("om"), F.col("content_hash").alias("oh"), F.lit(True).alias("was"))
    n = new.select("path", F.col("mtime_ms").alias("nm"), F.col("content_hash").alias("nh"), F.lit(True).alias("now"))
    op = (
        F.when(F.col("now").isNull(), "deleted")
        .when(F.col("was").isNotNull() & (F.abs(F.col("nm") - F.col("om")) < 1), "unchanged")
        .when(F.col("nh").isNull(), "unparsable")
        .when(F.col("was").isNull(), "new")
        .when(F.col("nh") == F.col("oh"), "mtime")
        .otherwise("changed")
    )
    return o.join(n, "path", "full_outer").select("path", op.alias("op"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after taking new in: changed and new rows from new, others from old, deleted ones gone."""
    ops = diff(old, new)
    taken = new.join(ops.where(F.col("op").isin("new", "changed", "mtime")).select("path"), "path", "left_semi")
    kept = old.join(ops.where(F.col("op").isin("unchanged", "unparsable")).select("path"), "path", "left_semi")
    return kept.unionByName(taken.select(*kept.columns))


def index_status(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Notes, files, and files that the index lacks."""
    missing = files.select("path").distinct().join(rows.select("path"), "path", "left_anti")
    return rows.agg(F.count("*").alias("note_count")).crossJoin(files.agg(F.countDistinct("path").alias("file_count"))).crossJoin(missing.agg(F.count("*").alias("missing")))


def export(notes: DataFrame, rules: list[tuple[str, str]], default: str = "private") -> DataFrame:
    """Notes that others may see: private ones dropped, listed ones with a summary for a body."""
    tier = T.visibility(F.col("path"), F.col("visibility"), rules, default)
    body = F.when(F.col("tier") == "listed", T.summarize(F.col("body"))).otherwise(F.col("body"))
    return notes.withColumn("tier", tier).where("tier <> 'private'").withColumn("body", body)


def export_tables(notes: DataFrame, embeddings: DataFrame, links: DataFrame, rules: list[tuple[str, str]], model_id: str, now: float, default: str = "private") -> dict[str, DataFrame]:
    """What a peer may read, by table: notes (path, title, tags, tier, updated_at), contents, embeddings and links of those notes, and meta.

    notes: path, title, tags, body, mtime_ms, visibility. embeddings: path, vec. links: path, target.
    """
    seen = export(notes, rules, default)
    paths = seen.select("path")
    meta = [("model_id", model_id), ("exported_at", str(int(now * 1000)))]
    return {
        "notes": seen.select("path", "title", "tags", "tier", F.col("mtime_ms").cast("long").alias("updated_at")),
        "contents": seen.select("path", "title", "tags", "body"),
        "embeddings": embeddings.join(paths, "path", "left_semi"),
        "links": links.join(paths, "path", "left_semi"),
        "meta": notes.sparkSession.createDataFrame(meta, "key string, value string"),
    }


def drop_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges without those of these ids."""
    return edges.join(ids.select("id").distinct(), "id", "left_anti").select(*edges.columns)


def submitted(queue: DataFrame, items: DataFrame, task: str, now: float) -> DataFrame:
    """The queue (id, task, target, reason, status, created_at) with new pending items (target, reason); one that it has already is not put in again."""
    key = F.substring(F.sha2(F.concat_ws("\n", F.lit(task), "target", F.coalesce("reason", F.lit(""))), 256), 1, 16)
    new = items.where("target <> ''").select(key.alias("id"), F.lit(task).alias("task"), "target", "reason", F.lit("pending").alias("status"), F.lit(now).alias("created_at")).dropDuplicates(["id"])
    return queue.unionByName(new.join(queue.select("id"), "id", "left_anti"))


def add_edges(edges: DataFrame, more: DataFrame, types: tuple[str, ...], confidences: tuple[str, ...] = ("high", "medium", "low")) -> DataFrame:
    """edges with the valid ones of more; an unknown type or confidence, or an empty end, is refused."""
    good = more.where(F.col("edge_type").isin(*types) & F.col("confidence").isin(*confidences) & (F.col("from_path") != "") & (F.col("to_path") != ""))
    return edges.unionByName(good.select(*edges.columns))


def review(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply decisions (id, decision confirm or reject, new_type) to edges of medium confidence; others stay."""
    d = decisions.select("id", "decision", "new_type")
    joined = edges.join(d, "id", "left")
    open_edge = (F.col("confidence") == "medium") & F.col("decision").isNotNull()
    out = joined.where(~(open_edge & (F.col("decision") == "reject")))
    confirmed = (F.col("confidence") == "medium") & F.coalesce(F.col("decision") == "confirm", F.lit(False))
    out = out.withColumn("edge_type", F.when(confirmed, F.coalesce("new_type", "edge_type")).otherwise(F.col("edge_type")))
    return out.withColumn("confidence", F.when(confirmed, "high").otherwise(F.col("confidence"))).select(*edges.columns)


def backfill(edges: DataFrame, walked: DataFrame, classified: DataFrame) -> DataFrame:
    """Archived edges, and for walked notes their newly classified ones; edges of notes not walked go."""
    archived = edges.where(F.col("archived"))
    return archived.unionByName(classified.join(walked.select(F.col("path").alias("from_path")), "from_path", "left_semi").select(*edges.columns))


def retraction_targets(events: DataFrame, peer_notes: DataFrame) -> DataFrame:
    """Per retracted path the peers that hold it; backslashes count as slashes."""
    path = F.replace(F.col("note_path"), F.lit("\\"), F.lit("/"))
    held = events.withColumn("path", path).join(peer_notes.select("peer_id", "path").distinct(), "path", "left")
    return held.groupBy("path").agg(F.array_sort(F.collect_set("peer_id")).alias("targets"))


def queue_status(queue: DataFrame, notes: DataFrame, now: float, days: int = 30) -> DataFrame:
    """Status of work items: missing target, target newer than the item, stale after so many days."""
    joined = queue.join(notes.select(F.col("path").alias("target"), "mtime"), "target", "left")
    pending = F.col("status") == "pending"
    status = F.when(pending & F.col("mtime").isNull(), "target_missing").when(pending & (F.col("mtime") > F.col("created_at")), "target_changed").when(pending & (F.lit(now) - F.col("created_at") > days * 86400), "stale").otherwise(F.col("status"))
    return joined.withColumn("status", status).select(*queue.columns)


def proposed_links(similar: DataFrame, links: DataFrame, most: int = 3, least: float = 0.65) -> DataFrame:
    """Up to three similar notes to link to that are not linked yet, and reciprocal links that are missing."""
    from pyspark.sql import Window

    fresh = similar.where(F.col("cosine") >= least).select(F.col("query_id").alias("src"), F.col("key").alias("dst"), "cosine").join(links, ["src", "dst"], "left_anti")
    w = Window.partitionBy("src").orderBy(F.desc("cosine"), "dst")
    new = fresh.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("src", "dst", F.lit("similar").alias("why"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(links, ["src", "dst"], "left_anti").distinct().withColumn("why", F.lit("reciprocal"))
    return new.unionByName(back)


def add_supersessions(known: DataFrame, new: DataFrame) -> DataFrame:
    """known with the valid ones of new (old_pattern_query, replacement_note_path, reason): patterns of blanks or stop words only are rejected."""
    from sparkatlas.functions.text import pattern_tokens

    valid = new.where(F.size(pattern_tokens(F.coalesce("old_pattern_query", F.lit("")))) > 0)
    return known.unionByName(valid.select(*known.columns)).distinct()


def remove_supersessions(known: DataFrame, gone: DataFrame) -> DataFrame:
    """known without those of these patterns."""
    return known.join(gone.select("old_pattern_query").distinct(), "old_pattern_query", "left_anti").select(*known.columns)


def remove_edges(edges: DataFrame, nodes: DataFrame, outgoing_only: bool = False) -> DataFrame:
    """Edges without those of these nodes (node), on either side; outgoing_only keeps edges into them, and archived ones."""
    gone = nodes.select("node").distinct()
    if outgoing_only:
        mine = edges.join(gone, edges["from_path"] == gone["node"], "left_semi").where("NOT archived")
        return edges.exceptAll(mine)
    out = edges.join(gone, edges["from_path"] == gone["node"], "left_anti")
    return out.join(gone, out["to_path"] == gone["node"], "left_anti")


def next_of_queue(items: DataFrame, visited: DataFrame, key: str = "path", most: int = 200) -> tuple[DataFrame, bool]:
    """The next items that were not visited, at most so many, in order of key, and whether a full pass was over (then it starts anew)."""
    left = items.join(visited.select(key).distinct(), key, "left_anti")
    over = not left.limit(1).count()
    return (items if over else left).orderBy(key).limit(most), over


def judged_links(suggested: DataFrame, links: DataFrame, notes: DataFrame) -> DataFrame:
    """(src, dst, reason) of suggested links: self, missing target, already linked (whatever its alias or case), or null if it may be made."""
    name = lambda c: F.lower(F.trim(F.substring_index(F.col(c), "|", 1)))
    known = notes.select(F.lower("name").alias("_dst")).distinct().withColumn("_known", F.lit(True))
    made = links.select(F.lower("src").alias("_src"), name("dst").alias("_dst")).distinct().withColumn("_made", F.lit(True))
    rows = suggested.select("src", "dst", F.lower("src").alias("_src"), name("dst").alias("_dst")).join(known, "_dst", "left").join(made, ["_src", "_dst"], "left")
    return rows.select("src", "dst", F.when(F.col("_src") == F.col("_dst"), "self").when(F.col("_known").isNull(), "missing").when(F.col("_made").isNotNull(), "linked").alias("reason"))


def update_queue(queue: DataFrame, changes: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """The queue with changed states (id, status) and, at its end, new items whose id it did not have."""
    later = changes.select("id", F.col("status").alias("_status"))
    out = queue.join(later, "id", "left").withColumn("status", F.coalesce("_status", "status")).select(*queue.columns)
    return out if new is None else out.unionByName(new.join(queue.select("id"), "id", "left_anti").select(*queue.columns))
