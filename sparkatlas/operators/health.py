"""State of a collection of notes: sweeps, routing, gates, memory decay, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkatlas.functions.text import ascii_edges

DAY = 86400.0


def fleeting_sweep(fleeting: DataFrame, references: DataFrame, now: float, stale_days: int = 60) -> DataFrame:
    """(path, status): PROMOTED with two or more referring permanent notes; STALE for a project's old note without any.

    fleeting: path, name, mtime, is_project, is_counterpoint. references: name, from_path. Counterpoints are skipped.
    """
    n = references.distinct().groupBy("name").agg(F.count("*").alias("n"))
    joined = fleeting.where(~F.col("is_counterpoint")).join(n, "name", "left").na.fill(0, ["n"])
    status = F.when(F.col("n") >= 2, "PROMOTED").when(F.col("is_project") & (F.col("n") == 0) & (F.lit(now) - F.col("mtime") >= stale_days * DAY), "STALE")
    return joined.select("path", "n", status.alias("status")).where("status IS NOT NULL")


# Phrases by which a note says what it is for.
INTENTIONS = ("when working on", "when designing", "when building", "use this for", "reference this for", "reference for", "apply to", "relevant to")
# Signs of a version or a date, and of a quantity.
VERSION = r"(?i)v\d+\.\d+|\b20\d{2}\b|deprecated"
QUANTITY = r"(?i)\d+\.?\d*\s*(ms|s|MB|GB|%|fps|req/s|items|notes|tokens)"


def intention_sentence(body: Column) -> Column:
    """The first sentence of a note that says what it is for; null without one."""
    phrase = f"(?i){'|'.join(INTENTIONS)}"
    return F.trim(F.get(F.filter(F.split(body, r"[.!?\n]"), lambda s: s.rlike(phrase)), F.lit(0)))


def inbox_status(notes: DataFrame, now: float) -> DataFrame:
    """intentioned, else resolved, else limbo, per inbox note (body, declared, inlinks, outlinks, mtime).

    A note is resolved if two notes link to it, if it was touched within seven
    days and has three links, or if it is declared so.
    """
    recent = F.lit(now) - F.col("mtime") <= 7 * DAY
    resolved = (F.col("inlinks") >= 2) | (recent & (F.col("outlinks") >= 3)) | F.coalesce("declared", F.lit(False))
    intention = intention_sentence(F.col("body"))
    return notes.withColumn("intention", intention).withColumn("status", F.when(F.col("intention").isNotNull(), "intentioned").when(resolved, "resolved").otherwise("limbo"))


def stale(age_days: Column, text: Column, least: int = 60) -> Column:
    """Old text that names a version or a date, and a quantity."""
    return (age_days >= least) & text.rlike(ascii_edges(VERSION)) & text.rlike(ascii_edges(QUANTITY))


def route(inlinks: Column, folder: Column) -> Column:
    """What to look at in a note: its links if nothing points to it, else its voice in the inbox."""
    return F.when(inlinks == 0, "link_check").when(folder.isin("inbox", "fleeting"), "voice_gate").otherwise("none")


CRITERIA = ("depth", "sourcing", "linking", "voice", "atomicity", "integrity")


def promote_gate(notes: DataFrame) -> DataFrame:
    """notes with passes, destination, rewrite and warning, from a flag for each of CRITERIA, synthesis and requested (a folder or null).

    Synthesis notes are judged without sourcing and integrity. All criteria, or
    all but voice (then with a rewrite), make a note permanent; failed integrity
    keeps any other at fleeting, as do three passes or more, and the rest stay
    in the inbox. A request for literature stands; one for permanent with two
    passes or fewer is turned down with a warning; one for the inbox doesn't
    hold back a note that passes everything.
    """
    exempt = F.coalesce("synthesis", F.lit(False))
    ok = {c: F.coalesce(F.col(c), F.lit(False)) | (exempt if c in ("sourcing", "integrity") else F.lit(False)) for c in CRITERIA}
    counted = sum((F.when(F.col(c) & ~(exempt if c in ("sourcing", "integrity") else F.lit(False)), 1).otherwise(0) for c in CRITERIA), F.lit(0))
    others = F.lit(True)
    for c in CRITERIA:
        others = others & (ok[c] if c != "voice" else F.lit(True))
    permanent = others  # with voice as is, without it rewritten
    place = F.when(permanent, "3-permanent").when(~ok["integrity"], "1-fleeting").when(F.col("passes") >= 3, "1-fleeting").otherwise("0-inbox")
    literature = F.coalesce(F.col("requested") == "2-literature", F.lit(False))
    demoted = F.coalesce(F.col("requested") == "3-permanent", F.lit(False)) & (F.col("passes") <= 2)
    out = notes.withColumn("passes", counted)
    out = out.withColumn("destination", F.when(literature, "2-literature").when(demoted, "0-inbox").otherwise(place))
    return out.withColumns({"rewrite": (F.col("destination") == "3-permanent") & ~ok["voice"], "warning": F.when(demoted & ~literature, "too few criteria for the requested folder")})


def claim_tier(claims: DataFrame, by: str) -> DataFrame:
    """Mean of (specificity + grounded) / 4 per note: shallow below 0.4, medium to 0.7, else deep."""
    score = claims.groupBy(by).agg(F.round(F.avg((F.col("specificity") + F.col("grounded")) / 4), 6).alias("score"))
    return score.withColumn("tier", F.when(F.col("score") < 0.4, "shallow").when(F.col("score") <= 0.7, "medium").otherwise("deep"))


def memory_decay(snapshots: DataFrame, seen: DataFrame, weak: int = 10, medium: int = 15) -> DataFrame:
    """(file, absent, strength): how many snapshots have passed since each file was last seen.

    snapshots: n (in order). seen: n, file.
    """
    last = snapshots.agg(F.max("n").alias("last"))
    missed = seen.groupBy("file").agg(F.max("n").alias("n")).crossJoin(F.broadcast(last)).withColumn("absent", F.col("last") - F.col("n"))
    return missed.select("file", "absent", F.when(F.col("absent") >= medium, "medium").when(F.col("absent") >= weak, "weak").otherwise("fresh").alias("strength"))


# Prompts that ask for nothing.
STOCK_PROMPTS = r"(?i)^(ok|yes|no|thanks|try\s+again|continue|go|sure|done)$"


def skipped_prompt(prompt: Column, least: int = 20) -> Column:
    """Short and stock prompts, judged without their end marks, and such as begin with <."""
    text = F.regexp_replace(F.trim(F.coalesce(prompt, F.lit(""))), r"[.!?,:;]+$", "")
    return (F.length(text) < least) | text.rlike(STOCK_PROMPTS) | F.startswith(text, F.lit("<"))


def injection_gate(scores: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Per prompt whether the best score of any backend reaches the threshold; short and stock prompts are skipped."""
    best = scores.groupBy("prompt_id", "prompt").agg(F.max("score").alias("best"))
    skip = skipped_prompt(F.col("prompt"))
    return best.select("prompt_id", "best", skip.alias("skipped"), (~skip & (F.coalesce("best", F.lit(0.0)) >= threshold)).alias("passed"))


def intentions(body: DataFrame) -> DataFrame:
    """(context, cue, path) of list items 'context — cue'."""
    items = body.select("path", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^\s*[-*] (.+ — .+)$"), 1)).alias("item"))
    parts = F.split("item", " — ", 2)
    return items.select(F.trim(parts[0]).alias("context"), F.trim(parts[1]).alias("cue"), "path")


def surnames(name: Column) -> Column:
    """Parts of a name or a list of names, in lower case and letters only; et, al and single letters are left out."""
    parts = F.filter(F.split(F.lower(name), r"[\s,&]+"), lambda s: (F.length(s) > 1) & ~s.isin("et", "al", "al."))
    return F.transform(parts, lambda s: F.regexp_replace(s, "[^a-z]", ""))


def author_matches(wanted: Column, authors: Column, first_only: bool = False) -> Column:
    """Whether any part of the claimed names equals, holds or lies within any part of an author's (or the first author's) name."""
    pool = F.slice(authors, 1, 1) if first_only else authors
    has = lambda a: F.exists(surnames(wanted), lambda w: F.exists(surnames(a), lambda s: F.contains(s, w) | F.contains(w, s)))
    return F.exists(pool, has)


def citation_issues(author: Column, year: Column, kind: Column, authors: Column, found_year: Column) -> Column:
    """Problems of a citation against its record (authors null: none): array of (issue, severity)."""
    issue = lambda name, severity: F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"))
    gap = F.abs(year - found_year)
    claimed = F.coalesce(author, F.lit("")) != ""
    any_author, first = author_matches(author, authors), author_matches(author, authors, True)
    out = F.array(
        F.when(authors.isNull(), issue("not_found", "high")),
        F.when(claimed & (F.size(authors) == 0), issue("unverifiable_author", "low")),
        F.when(claimed & (F.size(authors) > 0) & ~any_author, issue("wrong_author", "high")),
        F.when(claimed & any_author & ~first, issue("author_not_first", "medium")),
        F.when(gap > 1, issue("wrong_year", "high")),
        F.when((gap == 1) & (kind == "pmid"), issue("year_off_by_one", "low")),
    )
    return F.array_compact(out)


def resolve_cascade(records: DataFrame, services: list[str]) -> DataFrame:
    """The record of each query from the first service, in order, whose authors match."""
    priority = F.coalesce(*[F.when(F.col("service") == s, F.lit(i)) for i, s in enumerate(services)])
    w = Window.partitionBy("query_id").orderBy("_p", "record_id")
    good = records.withColumn("_p", priority).where(F.col("_p").isNotNull() & author_matches(F.col("author"), F.col("authors")))
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def text_of_index(index: DataFrame) -> DataFrame:
    """(key, text) from an inverted index (key, word, places)."""
    words = index.select("key", "word", F.explode("places").alias("at"))
    return words.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))


def due(hours_since: Column, modified: Column, hours: float = 24, least: int = 5) -> Column:
    """A job is due after so many hours if enough notes changed."""
    return (hours_since >= hours) & (modified >= least)


def backfill_stats(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes scanned and with edges, and edges by type and confidence, as (kind, value, n)."""
    scanned = notes.agg(F.count("*").alias("n")).select(F.lit("scanned").alias("kind"), F.lit("all").alias("value"), "n")
    having = edges.agg(F.countDistinct("from_path").alias("n")).select(F.lit("with_edges").alias("kind"), F.lit("all").alias("value"), "n")
    by = lambda c: edges.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "value", "n")
    return scanned.unionByName(having).unionByName(by("edge_type")).unionByName(by("confidence"))


def intention_counts(items: DataFrame, detail: str | None = None) -> DataFrame:
    """(context, n) of intentions, most frequent first; detail: only contexts or cues that hold this text."""
    if detail is not None:
        part = F.lit(detail.lower())
        items = items.where(F.contains(F.lower("context"), part) | F.contains(F.lower("cue"), part))
    return items.groupBy("context").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "context")


def write_checks(drafts: DataFrame, notes: DataFrame, similar: DataFrame, least: float = 0.85) -> DataFrame:
    """(path, verdict, reasons) of drafts: denied for duplicate tags, warned of links to no note and of a title much like another's.

    drafts: path, tags (array), links (array of names). notes: name. similar: path, key, cosine.
    """
    names = notes.select(F.lower("name").alias("_name")).distinct()
    linked = drafts.select("path", F.explode("links").alias("link")).select("path", "link", F.lower(F.trim("link")).alias("_name"))
    broken = linked.join(names, "_name", "left_anti").groupBy("path").agg(F.array_sort(F.collect_set("link")).alias("broken"))
    near = similar.where(F.col("cosine") >= least).groupBy("path").agg(F.max_by("key", F.struct("cosine", "key")).alias("near"))
    both = drafts.select("path", (F.size("tags") > F.size(F.array_distinct("tags"))).alias("twice")).join(broken, "path", "left").join(near, "path", "left")
    reasons = F.array_compact(F.array(F.when(F.col("twice"), "duplicate tags"), F.when(F.col("broken").isNotNull(), F.concat(F.lit("broken links: "), F.array_join("broken", ", "))), F.when(F.col("near").isNotNull(), F.concat(F.lit("similar to "), F.col("near").cast("string")))))
    verdict = F.when(F.col("twice"), "deny").when(F.size(reasons) > 0, "warn").otherwise("ok")
    return both.select("path", verdict.alias("verdict"), reasons.alias("reasons"))
