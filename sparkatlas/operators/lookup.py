"""Lookups of notes, links and edges, stated picks, and duplicate suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkatlas.operators.storage import held, written


def _tail(path: str):
    return F.substring_index(F.col(path), "/", -1)


def find_paths(notes: DataFrame, wanted: DataFrame, exact: bool = True) -> DataFrame:
    """(wanted_id, name, path): the note at this path, else the least path that ends with name; null if there is none.

    notes: path. wanted: wanted_id, name. Suffixes are looked up by equality:
    the last part of a path is cut to the lengths that names ask for.
    """
    paths = notes.select("path").where("path IS NOT NULL").distinct()
    asked = wanted.select("wanted_id", "name").distinct()
    lengths = [r[0] for r in asked.select(F.length(_tail("name"))).distinct().collect() if r[0]]  # at most as many as a file name is long
    cut = paths.select("path", _tail("path").alias("tail"))
    cut = cut.select("path", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)])).alias("n"), "tail").where("length(tail) >= n").select("path", F.expr("right(tail, n)").alias("end"))
    ends = asked.withColumn("end", _tail("name")).join(cut, "end").where(F.expr("endswith(path, name)")).groupBy("wanted_id", "name").agg(F.min("path").alias("by_end"))
    found = asked.join(ends, ["wanted_id", "name"], "left")
    if not exact:
        return found.withColumnRenamed("by_end", "path")
    at = paths.select(F.col("path").alias("name"), F.col("path").alias("whole"))
    return found.join(at, "name", "left").select("wanted_id", "name", F.coalesce("whole", "by_end").alias("path"))


def fetch(notes: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the notes with these keys, each once; unknown keys are left out."""
    return notes.select("key", *columns).join(keys.select("key").distinct(), "key", "left_semi")


def with_content(notes: DataFrame, content: DataFrame) -> DataFrame:
    """Every note with its body, null where it has none."""
    return notes.join(content.select("key", "body"), "key", "left")


def note_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges out of and into each of the nodes: (node, direction, other, edge_type, confidence)."""
    out = edges.select(F.col("from_path").alias("node"), F.lit("out").alias("direction"), F.col("to_path").alias("other"), "edge_type", "confidence")
    into = edges.select(F.col("to_path").alias("node"), F.lit("in").alias("direction"), F.col("from_path").alias("other"), "edge_type", "confidence")
    return out.unionByName(into).join(nodes.select("node").distinct(), "node", "left_semi")


def note_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_in, n_out) of each of the nodes, zeros included."""
    wanted = nodes.select("node").distinct()
    ends = links.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(links.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return wanted.join(sums, "node", "left").na.fill(0, ["n_in", "n_out"])


def without_inlinks(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes (path) to which no link (target) leads; a note goes by its path below the top folder, and links with a bracket don't count."""
    top = F.expr("substring(path, 1, instr(path, '/'))")
    name = F.replace(F.replace(F.col("path"), F.lit(".md"), F.lit("")), top, F.lit(""))
    sound = links.where(~F.contains(F.col("target"), F.lit("["))).select(F.col("target").alias("_name")).distinct()
    return notes.withColumn("_name", name).join(sound, "_name", "left_anti").drop("_name")


def link_stats(notes: DataFrame, links: DataFrame, permanent: str = "3-permanent", maps: str = "5-maps") -> DataFrame:
    """(kind, name, n, zero_inlinks, ratio): notes and links in all, each top folder's notes and those without inlinks, and permanent notes for each map."""
    folder = F.substring_index("path", "/", 1).alias("name")
    lone = without_inlinks(notes, links).select("path", F.lit(1).alias("lone"))
    by = notes.select("path", folder).join(lone, "path", "left").groupBy("name").agg(F.count("*").alias("n"), F.count("lone").alias("zero_inlinks"))
    by = by.select(F.lit("folder").alias("kind"), "name", "n", "zero_inlinks", F.lit(None).cast("double").alias("ratio"))
    none = F.lit(None).cast("long")
    total = notes.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("notes").alias("name"), "n", none, F.lit(None).cast("double"))
    all_links = links.where(~F.contains(F.col("target"), F.lit("["))).agg(F.count("*").alias("n")).select(F.lit("total"), F.lit("links"), "n", none, F.lit(None).cast("double"))
    count = lambda f: F.count(F.when(F.substring_index("path", "/", 1) == f, 1))
    share = notes.agg(F.round(count(permanent) / F.greatest(count(maps), F.lit(1)), 2).alias("ratio")).select(F.lit("ratio"), F.lit("permanent to maps"), none, none, "ratio")
    return by.union(total).union(all_links).union(share)


def tag_counts(notes: DataFrame, least: int = 3) -> DataFrame:
    """(tag, n) of tags (arrays of notes), in lower case, that so many notes have, most frequent first."""
    counted = notes.select("key", F.explode("tags").alias("tag")).select("key", F.lower("tag").alias("tag")).distinct().groupBy("tag").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).orderBy(F.desc("n"), "tag")


def zero_outlink(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes (node) that link to nothing."""
    return notes.select("node").distinct().join(links.select(F.col("src").alias("node")), "node", "left_anti")


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0, once: bool = False) -> DataFrame:
    """n rows of each stratum in the order of a hash of seed and key: the same pick for the same seed; once: of equal rows one counts.

    Hashes begin in 65,536 ways, and each that occurs has a row or more, so the
    n-th of those that occur in a stratum bounds its pick: rows beyond it are
    dropped as they are read, and only the rest is told apart and sorted.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    begin = rows.select(F.col(stratum).alias("_stratum"), F.substring(hashed, 1, 4).alias("_begin")).distinct()
    nth = begin.withColumn("_n", F.row_number().over(Window.partitionBy("_stratum").orderBy("_begin"))).where(F.col("_n") == n)
    bound = held(nth.select("_stratum", F.col("_begin").alias("_last")), "sample-bounds")
    few = rows.withColumn("_hash", hashed).join(bound, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    few = few.where(F.col("_last").isNull() | F.col("_hash").isNull() | (F.substring("_hash", 1, 4) <= F.col("_last"))).drop("_stratum", "_last")
    few = few.distinct() if once else few
    order = Window.partitionBy(stratum).orderBy("_hash", key)
    return few.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n).drop("_hash")


def unvisited_pick(rows: DataFrame, visited: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The next n rows, in hash order, that were not visited; of all rows once every one has been."""
    left = rows.join(visited.select(key).distinct(), key, "left_anti")
    pool = left if left.limit(1).count() else rows
    return pool.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def oldest(notes: DataFrame, group: str, n: int = 5) -> DataFrame:
    """The n notes of each group that were touched longest ago."""
    order = Window.partitionBy(group).orderBy("mtime", "key")
    return notes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def numbered(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in an order of the whole table, without sorting it in one task.

    Ranges of the order are sorted side by side; a place is the number of rows
    of the ranges before and of those before it in its own. Rows that tie share
    a range, and are numbered as they come.
    """
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id holds the range in its upper bits and the row's place there in the lower 33
    placed = written(placed.withColumn("_id", at).withColumn("_range", F.shiftright("_id", 33)), "numbered")
    sizes = sorted((r["_range"], r.n) for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_range long, _before long")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, place).drop("_id", "_range", "_before")


def nearest_values(rows: DataFrame, queries: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """(query_id, key, score, rank) of the k rows of a query's group whose value is nearest to its own; score is the distance below zero, ties go by key.

    rows: key, group, value. queries: query_id, the key of a row. The rows are
    sorted by value once upward and once downward, and each query looks at k
    places on from its own in either order, however many rows its group has.
    """
    known = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select("key", group, value)
    up = written(numbered(known, F.asc(group), F.asc(value), F.asc("key"), name="place"), "upward")
    down = written(numbered(known, F.asc(group), F.desc(value), F.asc("key"), name="place"), "downward")
    asked = queries.select("query_id").join(known.withColumnsRenamed({"key": "query_id", value: "_own"}), "query_id")

    def side(places: DataFrame, edge: Column, first: int) -> DataFrame:
        own = asked.join(places.groupBy(group, F.col(value).alias("_own")).agg(edge.alias("_edge")), [group, "_own"])
        seen = own.select("query_id", F.col(group).alias("_group"), "_own", F.explode(F.sequence(F.col("_edge") + first, F.col("_edge") + first + k - 1)).alias("place"))
        found = seen.join(places, "place").where(F.col("_group") == F.col(group))
        return found.select("query_id", "key", (-F.abs(F.col(value) - F.col("_own"))).cast("double").alias("score"))

    both = side(up, F.min("place"), 0).unionByName(side(down, F.max("place"), 1))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_size(clusters: DataFrame) -> DataFrame:
    """(cluster, size, rank): clusters (cluster, key) in the order of falling size."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    return numbered(sizes, F.desc("size"), F.asc("cluster"))


def not_injected(found: DataFrame, injected: DataFrame) -> DataFrame:
    """Results (session_id, path) that their session has not been shown."""
    return found.join(injected.select("session_id", "path").distinct(), ["session_id", "path"], "left_anti")


def first_of_event(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first event of each key; events whose key is blank throughout are all kept."""
    blank = F.lit(True)
    for k in keys:
        blank = blank & (F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) == "")
    first = Window.partitionBy(*keys).orderBy(order)
    return events.withColumn("_blank", blank).withColumn("_n", F.row_number().over(first)).where("_blank OR _n = 1").drop("_blank", "_n")
