"""Readers of note trees, drawings, logs, peers and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkatlas.functions import text as T


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, full_path, mtime_ms, raw) of all .md files; entries that begin with '.' and folders that begin with '_' are skipped.

    Spark's readers hide files that begin with '_' too, so those are left out;
    files that can't be read or decoded are skipped.
    """
    return _decoded(_files(spark, [root], root))


def list_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, full_path, mtime_ms) of the same files; none is opened."""
    return _files(spark, [root], root).select("path", "full_path", "mtime_ms")


def read_files(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """Like scan_markdown, of these files below root only; those that have gone meanwhile are skipped."""
    return _decoded(_files(spark, paths, root))


def _files(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("pathGlobFilter", "*.md")
    clean = F.regexp_replace("path", r"^\w+:/+", "/")
    base = root.rstrip("/").removeprefix("file://") + "/"
    rel = F.substring_index(clean, base, -1)
    hidden = rel.rlike(r"(^|/)\.") | rel.rlike(r"(^|/)_[^/]*/")
    mtime = F.unix_micros("modificationTime") / 1000.0
    return reader.load(paths).where(~hidden).select(rel.alias("path"), F.col("path").alias("full_path"), mtime.alias("mtime_ms"), "content")


def _decoded(files: DataFrame) -> DataFrame:
    return files.select("path", "full_path", "mtime_ms", F.expr("try_validate_utf8(CAST(content AS STRING))").alias("raw")).where("raw IS NOT NULL")


def parse_notes(raw: DataFrame) -> DataFrame:
    """Notes from (path, raw, ...): title, tags, links, cleaned body, text to embed and its hash. Notes without a body are dropped.

    Drawings (.excalidraw.md) are told by their suffix.
    """
    drawing = F.col("path").endswith(".excalidraw.md")
    front = T.frontmatter(F.col("raw"))
    body = F.when(drawing, drawing_text(F.col("raw"))).otherwise(T.body_of(F.col("raw")))
    tags = F.when(drawing, F.array(F.lit("drawing"))).otherwise(T.inline_tags(front))
    out = raw.withColumn("_body", body).where(F.trim("_body") != "")
    out = out.withColumns({"title": T.title_from_path(F.col("path")), "tags": tags, "links": T.wikilinks(F.col("_body")), "body": T.clean_links(F.col("_body")), "visibility": F.nullif(F.regexp_extract(front, r"(?m)^visibility:[ \t]*(\w+)", 1), F.lit(""))})
    embed = T.embedding_text(F.col("title"), F.col("body"), F.col("tags"))
    return out.withColumn("embed_text", embed).withColumn("content_hash", T.content_hash(F.col("embed_text"))).drop("_body", "raw")


def drawing_text(raw: Column) -> Column:
    """Texts of a drawing's elements that are not deleted, one a line."""
    block = F.regexp_extract(raw, r"(?s)```json\n(.*?)\n```", 1)
    parsed = F.from_json(block, "elements array<struct<type:string,text:string,isDeleted:boolean>>")
    shown = F.filter(parsed["elements"], lambda e: (e["type"] == "text") & (e["text"] != "") & ~F.coalesce(e["isDeleted"], F.lit(False)))
    return F.array_join(F.transform(shown, lambda e: e["text"]), "\n")


def read_log(spark: SparkSession, root: str, prefix: str, schema: str) -> DataFrame:
    """All lines of the log files with a prefix; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{root}/{prefix}*.jsonl")


def read_peers(spark: SparkSession, root: str, model_id: str) -> tuple[DataFrame, DataFrame]:
    """Notes of all peers (folders peer_id=...), and per peer whether its vectors fit ours."""
    peers = spark.read.option("basePath", root).parquet(f"{root}/peer_id=*")
    meta = peers.groupBy("peer_id").agg(F.max("model_id").alias("model_id"))
    return peers, meta.withColumn("fits", F.col("model_id").eqNullSafe(F.lit(model_id)))


def episodes(lines: DataFrame) -> DataFrame:
    """(project, date, score, snippet) from lines (n, line) of a listing 'N. [project, date] - P% match' and the quoted line after each."""
    head = r"^\s*\d+\.\s+\[([^,\]]+),\s*([^\]]+)\]\s+-\s+(\d+)%\s+match"
    w = Window.orderBy("n")  # a listing is a screenful
    both = lines.withColumn("after", F.lead("line").over(w)).where(F.col("line").rlike(head))
    return both.select(F.trim(F.regexp_extract("line", head, 1)).alias("project"), F.trim(F.regexp_extract("line", head, 2)).alias("date"), (F.regexp_extract("line", head, 3).cast("double") / 100).alias("score"), F.regexp_extract("after", r'"(.*)"', 1).alias("snippet"))


def last_user_messages(turns: DataFrame, by: str, order: str, most: int = 80) -> DataFrame:
    """The user's messages among the last lines of each transcript."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= most) & (F.col("role") == "user")).drop("_n")


def list_notes(notes: DataFrame, limit: int | None = None) -> DataFrame:
    out = notes.select("path", "tags").orderBy("path")
    return out if limit is None else out.limit(limit)


def read_head(raw: Column, most: int = 500, cap: int = 1500) -> Column:
    """The start of a note's body, and of that no more than the cap, with a mark where it was cut."""
    head = F.substring(T.body_of(raw), 1, most)
    return F.when(F.length(head) > cap, F.concat(F.substring(head, 1, cap), F.lit("…"))).otherwise(head)


def message_text(content: Column) -> Column:
    """The text of a message whose content is a string, or JSON of a string or of blocks {type, text}."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    said = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v")
    return F.when(content.startswith("["), said).when(content.startswith('"'), quoted).otherwise(content)
