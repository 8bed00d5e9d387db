"""Search over peers as one plan: full-text statistics, scores and ranks by peer, a peer being a column.

Peers whose vectors come from our model are asked by vector and by text, others
by text only. However many peers there are, their notes are one table and the
number of jobs is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkatlas.operators import bm25, fusion
from sparkatlas.operators.kept_text import PLACE_BITS, tokenised
from sparkatlas.operators.storage import held, written
from sparkatlas.operators.vectors import ROWS, Best, _blocks, _matrix

#: Rows of lists that a task holds at most, about.
HELD = 1 << 21


def text_lists(notes: DataFrame, texts: DataFrame, top: int = fusion.SIGNAL_TOP, fields: bm25.Fields = bm25.Fields()) -> DataFrame:
    """(query_id, peer_id, key, score, rank) by BM25 within each peer; notes: peer_id, key and the fields' columns, peer_id null for our own."""
    # a peer's key is its own: the two together tell a note
    names = [n for n, _ in fields.weights]
    place = F.struct(F.col("peer_id"), F.col("key").cast("long").alias("key"))
    found = tokenised(notes.select(F.to_json(place).alias("key"), *names), fields, "string")
    found = written(found.withColumn("id", F.from_json("key", "peer_id string, key long")).select("id.peer_id", "id.key", "length", "found"), "peer-notes")
    totals = held(found.groupBy("peer_id").agg(F.count("*").alias("n_docs"), F.avg("length").alias("average")), "peer-totals")
    asked = held(bm25.phrases_of(texts).withColumn("pid", F.array_join("terms", " ")), "phrases")
    parts = asked.select("pid", "terms").distinct().select("pid", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("at", "term"))
    postings = found.select("peer_id", "key", "length", F.explode("found").alias("x")).select("peer_id", "key", "length", "x.*")
    hits = postings.join(held(parts, "phrase-terms"), "term")
    weight = F.coalesce(*[F.when(F.shiftright("start", PLACE_BITS) == i, F.lit(w)) for i, (_, w) in enumerate(fields.weights)])
    starts = hits.select("pid", "n_terms", "peer_id", "key", "length", F.explode(F.transform("places", lambda p: p - F.col("at"))).alias("start"))
    freq = starts.groupBy("pid", "n_terms", "peer_id", "key", "length", "start").agg(F.count("*").alias("n")).where("n = n_terms")
    freq = written(freq.groupBy("pid", "peer_id", "key", "length").agg(F.sum(weight).alias("f")), "peer-phrases")
    has = freq.groupBy("pid", "peer_id").agg(F.count("*").alias("n_has"))
    same = freq["peer_id"].eqNullSafe(F.col("_peer"))
    stats = has.join(totals.withColumnRenamed("peer_id", "_peer"), has["peer_id"].eqNullSafe(F.col("_peer"))).drop("peer_id")
    idf = F.log((F.col("n_docs") - F.col("n_has") + 0.5) / (F.col("n_has") + 0.5))
    stats = stats.withColumn("idf", F.when(idf <= 0, 1e-6).otherwise(idf)).withColumnRenamed("pid", "_pid")
    part = F.col("idf") * F.col("f") * (fields.k1 + 1) / (F.col("f") + fields.k1 * (1 - fields.b + fields.b * F.col("length") / F.col("average")))
    scored = freq.join(stats, (freq["pid"] == F.col("_pid")) & same).select("pid", "peer_id", "key", part.alias("part"))
    whole = asked.select("query_id", "n_phrases", "phrase", "pid").join(scored, "pid").groupBy("query_id", "peer_id", "key", "n_phrases").agg((-F.sum("part")).alias("score"), F.count("*").alias("matched"))
    order = Window.partitionBy("query_id", "peer_id").orderBy("score", "key")
    return whole.where("matched = n_phrases").select("query_id", "peer_id", "key", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)


def vector_lists(vecs: DataFrame, query_vecs: DataFrame, top: int = fusion.SIGNAL_TOP) -> DataFrame:
    """(query_id, peer_id, key, score, rank) by dot product within each peer; vecs: peer_id, key, vec."""
    spark, parts = vecs.sparkSession, []
    schema = "query_id long, peer_id string, key long, score double"
    for keys, block in _blocks(query_vecs, 1 << 20):
        shared = spark.sparkContext.broadcast((np.array(keys), block))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found: dict[str | None, Best] = {}

            def out() -> Iterator[pa.RecordBatch]:
                for peer, own in found.items():
                    for ids, key, score in own.rows():
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([peer] * len(ids), pa.string()), pa.array(key), pa.array(score)], names=["query_id", "peer_id", "key", "score"])

            for batch in batches:
                for first in range(0, batch.num_rows, ROWS):
                    part = batch.slice(first, ROWS)
                    m, rows = _matrix(part.column(2), shared.value[1].shape[1])
                    own = part.column(1).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
                    names = part.column(0).dictionary_encode()
                    code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)[rows]
                    for c in np.unique(code):
                        peer = names.dictionary[int(c)].as_py() if c >= 0 else None
                        found.setdefault(peer, Best(*shared.value, top)).add(own[code == c], m[code == c])
                    if sum(map(len, found.values())) > HELD:  # lists of very many peers go on as they are
                        yield from out()
                        found.clear()
            yield from out()

        parts.append(vecs.select("peer_id", "key", "vec").mapInArrow(best, schema))
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("query_id", "peer_id").orderBy(F.desc("score"), "key")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def peer_lists(notes: DataFrame, vecs: DataFrame, fits: DataFrame, texts: DataFrame, query_vecs: DataFrame, top: int = fusion.SIGNAL_TOP) -> DataFrame:
    """(query_id, key, rank) of all peers' lists; keys carry the peer's name. fits: peer_id and whether its vectors are of our model."""
    ours = vecs.where("peer_id IS NULL").unionByName(vecs.join(fits.where("fits").select("peer_id"), "peer_id", "left_semi"))
    both = text_lists(notes, texts, top).unionByName(vector_lists(ours, query_vecs, top))
    name = F.when(F.col("peer_id").isNull(), F.col("key").cast("string")).otherwise(F.concat(F.lit("peer:"), "peer_id", F.lit("/"), F.col("key").cast("string")))
    return both.select("query_id", name.alias("key"), "rank")


def search(notes: DataFrame, vecs: DataFrame, fits: DataFrame, texts: DataFrame, query_vecs: DataFrame, local: list[DataFrame] | None = None, top: int = 10) -> DataFrame:
    """(query_id, key, score, rank): one fusion over our lists and all peers'. local: further lists of our own (query_id, key, rank)."""
    more = [s.select("query_id", F.col("key").cast("string").alias("key"), "rank") for s in local or []]
    return fusion.rrf([peer_lists(notes, vecs, fits, texts, query_vecs), *more], top=top)
