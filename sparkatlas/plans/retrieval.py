"""Queries of retrieval: vectors, fusion, full text, hybrid, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkatlas.functions.vectors import normalised
from sparkatlas.operators import evaluate, federation, fusion, lookup, models, review, vectors
from sparkatlas.operators import near_pairs as pair_index
from sparkatlas.operators.storage import written
from sparkatlas.plans import adapters as A
from sparkatlas.plans import kept
from sparkatlas.plans.registry import query, table

TOP_SQL = f"""WITH {A.VECS_SQL},
s AS (SELECT query_id, v.key, list_dot_product(q.vec, v.vec) AS score FROM q, vecs v WHERE len(q.vec) = len(v.vec)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s)"""


@query("vector_topk", f"{TOP_SQL} SELECT query_id, key, round(score, 6) AS score, rank FROM top WHERE rank <= 30")
def vector_topk(spark, d):
    return vectors.top_k(A.vecs(spark, d), A.query_vecs(spark, d), 30).withColumn("score", F.round("score", 6))


@query("kept_vector_search", f"{TOP_SQL} SELECT query_id, key, round(score, 6) AS score, rank FROM top WHERE rank <= 30")
def kept_vector_search(spark, d):
    """The same search in the kept index, by cells whose bound reaches the k-th score."""
    return kept.vector_index(spark, d).search(A.query_vecs(spark, d), 30).withColumn("score", F.round("score", 6))


@query(
    "similar_notes",
    f"""WITH {A.VECS_SQL},
s AS (SELECT query_id, v.key, list_dot_product(q.vec, v.vec) AS cosine FROM q, vecs v WHERE v.key <> query_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, key) AS rank FROM s)
SELECT query_id, key, rank, round(cosine, 6) AS cosine, round(1 - cosine * cosine / 2, 4) AS ref_score,
       round(least(1.0, sqrt(greatest(0.0, 2 * (1 - round(1 - cosine * cosine / 2, 4))))), 6) AS cosine_back FROM top WHERE rank <= 10""",
)
def similar_notes(spark, d):
    found = vectors.similar(A.vecs(spark, d), A.query_vecs(spark, d), 10)
    return found.withColumn("cosine", F.round("cosine", 6)).withColumn("cosine_back", F.round("cosine_back", 6))


#: The tables' vectors are all but independent: the closest of them have a cosine of about 0.5, so "near" begins lower here.
NEAR = 0.38

PAIRS_SQL = f"""WITH {A.VECS_SQL},
u AS (SELECT key, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM vecs),
pairs AS (SELECT x.key AS a, y.key AS b, list_dot_product(x.vec, y.vec) AS s FROM u x JOIN u y ON x.key < y.key)"""


@query("discriminate_pairs", f"{PAIRS_SQL} SELECT a, b, round(s, 6) AS similarity FROM pairs WHERE s >= {NEAR}")
def discriminate_pairs(spark, d):
    return vectors.similar_pairs(A.unit_vecs(spark, d), NEAR).withColumn("similarity", F.round("similarity", 6))


#: Greedy clustering one vector at a time: a free one leads, and takes its later partners that are free.
LEADERS_SQL = f"""WITH RECURSIVE {A.VECS_SQL},
u AS (SELECT key, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM vecs),
pairs AS MATERIALIZED (SELECT x.key AS a, y.key AS b FROM u x JOIN u y ON x.key < y.key WHERE list_dot_product(x.vec, y.vec) >= {NEAR}),
later AS MATERIALIZED (SELECT key, list(b ORDER BY b) FILTER (WHERE b IS NOT NULL) AS partners, row_number() OVER (ORDER BY key) AS n
  FROM (SELECT a AS key, b FROM pairs UNION ALL SELECT b, NULL FROM pairs) GROUP BY key),
run AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS leader, []::BIGINT[] AS members, []::BIGINT[] AS taken
  UNION ALL SELECT n, leader, members, CASE WHEN leader IS NULL THEN taken ELSE list_concat(list_append(taken, leader), members) END FROM (
    SELECT l.n, CASE WHEN list_contains(r.taken, l.key) THEN NULL ELSE l.key END AS leader,
      CASE WHEN list_contains(r.taken, l.key) THEN []::BIGINT[] ELSE list_filter(coalesce(l.partners, []::BIGINT[]), lambda m: NOT list_contains(r.taken, m)) END AS members, r.taken AS taken
    FROM run r JOIN later l ON l.n = r.n + 1))
SELECT leader, unnest(list_prepend(leader, members)) AS member FROM run WHERE len(members) > 0"""


@query("leader_clusters", LEADERS_SQL)
def leader_clusters(spark, d):
    return vectors.leader_clusters(vectors.similar_pairs(A.unit_vecs(spark, d), NEAR))


@query(
    "near_pairs",
    f"""WITH {A.VECS_SQL},
w AS (SELECT key, vec FROM vecs UNION ALL SELECT key + 1000000000, list_transform(vec, lambda x, i: x * (1 + 0.1 * ((key + i - 1) % 5 - 2))) FROM vecs WHERE key % 3 = 0),
u AS (SELECT key, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM w),
pairs AS (SELECT x.key AS a, y.key AS b, list_dot_product(x.vec, y.vec) AS s FROM u x JOIN u y ON x.key < y.key)
SELECT a, b, round(s, 6) AS similarity FROM pairs WHERE s >= 0.85""",
)
def near_pairs(spark, d):
    """Pairs at the default threshold, through the hyperplane index: a third of the vectors come again, changed a little."""
    vecs = A.vecs(spark, d).select("key", F.col("vec").cast("array<double>").alias("vec"))
    changed = F.transform("vec", lambda x, i: x * (1 + 0.1 * (F.pmod(F.col("key") + i, F.lit(5)) - 2)))
    again = vecs.where("key % 3 = 0").select((F.col("key") + 1000000000).alias("key"), changed.alias("vec"))
    return pair_index.near_pairs(vecs.unionByName(again), 0.85, 0.99).withColumn("similarity", F.round("similarity", 6))


INFO_SQL = "info AS (SELECT doc_id AS key, lang || (doc_id % 7) AS name, source AS folder, doc_id % 5 = 0 AS is_new FROM documents WHERE source <> 'src3')"


@query(
    "refinement_candidates",
    f"""{PAIRS_SQL}, {INFO_SQL},
ways AS (SELECT a AS note, b AS other, s FROM pairs WHERE s >= 0.3 UNION ALL SELECT b, a, s FROM pairs WHERE s >= 0.3),
near AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY s DESC, other) AS place FROM ways),
ok AS (SELECT note, other, s FROM near JOIN info x ON x.key = note JOIN info y ON y.key = other WHERE place <= 10 AND s <= 0.45 AND x.name <> y.name AND NOT (x.is_new AND y.is_new) AND NOT (x.folder = 'src1' AND y.folder = 'src1')),
r AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY s DESC, other) AS n FROM ok)
SELECT row_number() OVER (ORDER BY note, n) AS id, note, other, round(s, 6) AS cosine, n FROM r WHERE n <= 5""",
)
def refinement_candidates(spark, d):
    info = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat("lang", F.col("doc_id") % 7).alias("name"), F.col("source").alias("folder"), (F.col("doc_id") % 5 == 0).alias("is_new"))
    near = vectors.nearest(A.unit_vecs(spark, d), 0.3, 10)
    return review.refinement(near, info, 0.3, 0.45, excluded=("src3",), literature="src1")


@query(
    "rocchio_expand",
    f"""{TOP_SQL},
m AS (SELECT query_id, i, avg(x) AS x FROM (SELECT t.query_id, unnest(range(1, len(v.vec) + 1)) AS i, unnest(v.vec) AS x FROM top t JOIN vecs v ON v.key = t.key WHERE t.rank <= 3) GROUP BY query_id, i),
b AS (SELECT query_id, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS qx FROM q),
p AS (SELECT query_id, i, 0.7 * qx + 0.3 * x AS y FROM b JOIN m USING (query_id, i)),
n AS (SELECT query_id, sqrt(sum(y * y)) AS size FROM p GROUP BY query_id)
SELECT query_id, i - 1 AS i, round(y / size, 6) AS x FROM p JOIN n USING (query_id)""",
)
def rocchio_expand(spark, d):
    vecs, q = A.vecs(spark, d), A.query_vecs(spark, d)
    moved = vectors.rocchio(vecs, q, vectors.top_k(vecs, q, 3))
    return moved.select("query_id", F.posexplode("vec").alias("i", "x")).select("query_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def _length_signal(spark, d):
    """A second ranked list per query: notes of its language closest to the query's note in length."""
    n = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "lang", F.col("n_chars").alias("n"))
    return lookup.nearest_values(n, n.where("key % 50 = 0").select(F.col("key").alias("query_id")), "lang", "n", 30)


FUSED_SQL = f"""{TOP_SQL},
n AS (SELECT doc_id AS key, lang, n_chars AS n FROM documents),
len_s AS (SELECT x.key AS query_id, y.key, -abs(y.n - x.n) AS score FROM n x JOIN n y USING (lang) WHERE x.key % 50 = 0),
len_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM len_s),
lists AS (SELECT query_id, key, rank FROM top WHERE rank <= 30 UNION ALL SELECT query_id, key, rank FROM len_top WHERE rank <= 30),
fused AS (SELECT query_id, key, sum(1.0 / (5 + rank)) AS score FROM lists GROUP BY query_id, key),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank FROM fused)"""


def _fused(spark, d):
    both = fusion.rrf([vectors.top_k(A.vecs(spark, d), A.query_vecs(spark, d), 30), _length_signal(spark, d)])
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
    return both.withColumn("rank", F.row_number().over(w))


@query("rrf_two_signal", f"{FUSED_SQL} SELECT query_id, key, round(score, 6) AS score, rank FROM final WHERE rank <= 30")
def rrf_two_signal(spark, d):
    return _fused(spark, d).where("rank <= 30").withColumn("score", F.round("score", 6))


@query(
    "seed_union",
    f"""{FUSED_SQL},
o AS (SELECT query_id, key, rank AS o FROM top WHERE rank <= 10 UNION ALL SELECT query_id, key, rank + 10 FROM len_top WHERE rank <= 10)
SELECT query_id, key, min(o) AS "order" FROM o GROUP BY query_id, key""",
)
def seed_union(spark, d):
    return fusion.seeds(vectors.top_k(A.vecs(spark, d), A.query_vecs(spark, d), 10), _length_signal(spark, d))


@query(
    "score_threshold",
    f"""{FUSED_SQL} SELECT query_id, (SELECT count(*) FROM documents) AS total_indexed, count(*) FILTER (WHERE score >= 0.15) AS above_threshold, 0.15::DOUBLE AS threshold FROM fused GROUP BY query_id""",
)
def score_threshold(spark, d):
    total = table(spark, d, "documents").count()
    out = fusion.envelope(_fused(spark, d), total).drop("hint")
    return out.withColumn("total_indexed", F.col("total_indexed").cast("long"))


@query(
    "temporal_rescore",
    f"""{FUSED_SQL}, {A.NOTES_SQL},
t AS (SELECT query_id, f.key, score * exp(-ln(2.0) * greatest(0.0, 1706745600.0 - mtime) / (30 * 86400.0)) AS score FROM fused f JOIN notes USING (key) WHERE mtime >= 1705000000.0)
SELECT query_id, key, round(score, 6) AS score FROM t""",
)
def temporal_rescore(spark, d):
    how = fusion.Temporal(after=1705000000.0, half_life_days=30, now=A.NOW)
    out = fusion.temporal(_fused(spark, d), A.notes(spark, d), how)
    known = out.join(A.notes(spark, d).select("key"), "key", "left_semi")
    return known.select("query_id", "key", F.round("score", 6).alias("score"))


@query(
    "tag_expand_idf",
    """WITH tags AS (SELECT p_partkey AS key, unnest([p_brand, p_type, p_brand || '/' || p_type || '/' || p_size]) AS tag FROM part),
f AS (SELECT tag, count(*) AS freq FROM tags GROUP BY tag HAVING count(*) BETWEEN 2 AND 20),
seeds AS (SELECT p_partkey AS key, p_partkey AS query_id FROM part WHERE p_partkey % 50 = 0),
w AS (SELECT DISTINCT query_id, tag, freq FROM seeds JOIN tags USING (key) JOIN f USING (tag)),
s AS (SELECT w.query_id, t.key, sum(ln((SELECT count(*) FROM part) / freq::DOUBLE)) AS score FROM w JOIN (SELECT DISTINCT key, tag FROM tags) t USING (tag) WHERE t.key <> w.query_id GROUP BY w.query_id, t.key),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s)
SELECT query_id, key, round(score, 6) AS score, rank FROM r WHERE rank <= 30""",
)
def tag_expand_idf(spark, d):
    part = table(spark, d, "part")
    tags = part.select(F.col("p_partkey").alias("key"), F.explode(F.array("p_brand", "p_type", F.concat_ws("/", "p_brand", "p_type", "p_size"))).alias("tag"))
    seeds = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("key"))
    return fusion.tag_expansion(tags, seeds, part.count()).withColumn("score", F.round("score", 6))


def _texts(spark, d):
    """The stated queries of text searches: the title of every document whose id is divisible by 50."""
    return A.notes(spark, d).where("key % 50 = 0").select(F.col("key").alias("query_id"), F.col("title").alias("text"))


@query("bm25_topk")
def bm25_topk(spark, d):
    """Searched in the kept index: no text is read but when its table's files have changed."""
    return kept.text_index(spark, d).search(_texts(spark, d)).withColumn("score", F.round("score", 6))


def _corpus(spark, d) -> fusion.Corpus:
    notes = A.notes(spark, d)
    tags = notes.select("key", F.explode(F.array("folder", "title")).alias("tag"))
    # notes link to the notes before and after them in their folder
    from pyspark.sql import Window

    w = Window.partitionBy("folder").orderBy("key")
    links = notes.select(F.col("key").alias("src"), F.lead("key").over(w).alias("dst")).where("dst IS NOT NULL")
    return fusion.Corpus(notes, kept.note_vectors(spark, d), kept.text_index(spark, d), tags, links)


@query("hybrid_query")
def hybrid_query(spark, d):
    texts = _texts(spark, d)
    asked = models.embed(texts.select(F.col("query_id").alias("key"), "text"), "text", models.HashingEmbedder(64), query=True).select(F.col("key").alias("query_id"), "vec")
    return fusion.hybrid(_corpus(spark, d), texts, asked).withColumn("score", F.round("score", 6))


@query(
    "federated_query",
    f"""WITH {A.VECS_SQL},
s AS (SELECT query_id, v.key, label, list_dot_product(q.vec, v.vec) AS score FROM q, vecs v),
l AS (SELECT query_id, CASE WHEN label % 2 = 0 THEN key::VARCHAR ELSE 'peer:p1/' || key END AS key, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY score DESC, s.key) AS rank FROM s),
f AS (SELECT query_id, key, sum(1.0 / (5 + rank)) AS score FROM l WHERE rank <= 30 GROUP BY query_id, key),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM f)
SELECT query_id, key, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
)
def federated_query(spark, d):
    vecs, q = A.vecs(spark, d), A.query_vecs(spark, d)
    local = vectors.top_k(vecs.where("label % 2 = 0"), q)
    peer = vectors.top_k(vecs.where("label % 2 = 1"), q)
    return fusion.federated([local], [("p1", [peer])]).withColumn("score", F.round("score", 6))


@query(
    "federated_search",
    f"""WITH {A.VECS_SQL}, own AS (SELECT o_orderkey AS key, CASE WHEN o_orderpriority[1] = '1' THEN NULL ELSE 'p' || o_orderpriority[1] END AS peer_id, o_custkey FROM orders),
t AS (SELECT key, peer_id, o_custkey::VARCHAR AS term, 10.0 AS w FROM own UNION ALL SELECT key, peer_id, l_partkey::VARCHAR, 1.0 FROM own JOIN lineitem ON l_orderkey = key),
len AS (SELECT coalesce(peer_id, '') AS p, key, count(*) AS length FROM t GROUP BY ALL), tot AS (SELECT p, count(*) AS n_docs, avg(length) AS average FROM len GROUP BY p),
f AS (SELECT coalesce(peer_id, '') AS p, key, term, sum(w) AS f FROM t GROUP BY ALL), has AS (SELECT p, term, count(*) AS n_has FROM f GROUP BY ALL),
ask AS (SELECT key AS query_id, key::VARCHAR AS term FROM vecs WHERE key % 50 = 0),
ts AS (SELECT query_id, p, key, CASE WHEN ln((n_docs - n_has + 0.5) / (n_has + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n_has + 0.5) / (n_has + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / average)) AS score FROM ask JOIN f USING (term) JOIN has USING (p, term) JOIN tot USING (p) JOIN len USING (p, key)),
vp AS (SELECT key, CASE WHEN label % 5 = 0 THEN '' ELSE 'p' || (label % 5 + 1) END AS p, vec FROM vecs),
vs AS (SELECT query_id, p, vp.key, list_dot_product(q.vec, vp.vec) AS score FROM q, vp WHERE p <> 'p3'),
l AS (SELECT query_id, p, key, row_number() OVER (PARTITION BY query_id, p ORDER BY score DESC, key) AS rank FROM ts UNION ALL SELECT query_id, p, key, row_number() OVER (PARTITION BY query_id, p ORDER BY score DESC, key) FROM vs),
s AS (SELECT query_id, CASE WHEN p = '' THEN key::VARCHAR ELSE 'peer:' || p || '/' || key END AS key, sum(1.0 / (5 + rank)) AS score FROM l WHERE rank <= 30 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s)
SELECT query_id, key, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
)
def federated_search(spark, d):
    """Orders as the notes of five peers (the first is ourselves; one has another model), customers' and parts' numbers as their words."""
    first = F.substring("o_orderpriority", 1, 1)
    peer = F.when(first != "1", F.concat(F.lit("p"), first))
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), " ").alias("body"))
    notes = table(spark, d, "orders").join(parts, "o_orderkey", "left").select(peer.alias("peer_id"), F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("title"), F.lit("").alias("tags"), "body")
    vecs = A.vecs(spark, d).select(F.when(F.col("label") % 5 != 0, F.concat(F.lit("p"), F.col("label") % 5 + 1)).alias("peer_id"), "key", "vec")
    fits = spark.createDataFrame([(f"p{i}", i != 3) for i in range(2, 6)], "peer_id string, fits boolean")
    asked = A.query_vecs(spark, d)
    found = federation.search(notes, vecs, fits, asked.select("query_id", F.col("query_id").cast("string").alias("text")), asked)
    return found.withColumn("score", F.round("score", 6))


def _by_label(vecs) -> evaluate.Labels:
    return evaluate.Labels(vecs.where("key % 50 = 0").select(F.col("key").alias("query_id"), "label"), vecs.select("key", "label"))


@query(
    "recall_mrr",
    f"""WITH {A.VECS_SQL},
s AS (SELECT query_id, v.key, list_dot_product(q.vec, v.vec) AS score FROM q, vecs v WHERE v.key <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s),
rel AS (SELECT x.key AS query_id, y.key FROM vecs x JOIN vecs y ON x.label = y.label AND x.key <> y.key WHERE x.key % 50 = 0),
sz AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
h AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS in5, count(*) AS in10, min(rank) AS f FROM r JOIN rel USING (query_id, key) WHERE rank <= 10 GROUP BY query_id)
SELECT count(*) AS num_queries, round(avg(coalesce(in5 / n, 0)), 6) AS recall_at_5, round(avg(coalesce(in10 / n, 0)), 6) AS recall_at_10,
       round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(CASE WHEN f = 1 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_1 FROM sz LEFT JOIN h USING (query_id)""",
)
def recall_mrr(spark, d):
    vecs = A.vecs(spark, d)
    ranked = vectors.top_k(vecs, A.query_vecs(spark, d), 10, skip_self=True)
    return evaluate.retrieval_metrics(ranked, _by_label(vecs))


@query(
    "rank_overlap_rho",
    f"""{FUSED_SQL},
j AS (SELECT f.query_id, f.key, f.rank AS a, t.rank AS b FROM final f JOIN top t ON f.query_id = t.query_id AND f.key = t.key WHERE f.rank <= 20 AND t.rank <= 20),
g AS (SELECT query_id, count(*) FILTER (WHERE a <= 5 AND b <= 5) / 5.0 AS o5, count(*) FILTER (WHERE a <= 10 AND b <= 10) / 10.0 AS o10,
      CASE WHEN count(*) < 2 THEN 0.0 ELSE 1 - 6.0 * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1)) END AS rho FROM j GROUP BY query_id)
SELECT query_id, round(coalesce(o5, 0), 6) AS overlap_5, round(coalesce(o10, 0), 6) AS overlap_10, round(coalesce(rho, 0), 6) AS rho FROM (SELECT DISTINCT query_id FROM final) LEFT JOIN g USING (query_id)""",
)
def rank_overlap_rho(spark, d):
    out = evaluate.overlap_and_rho(_fused(spark, d), vectors.top_k(A.vecs(spark, d), A.query_vecs(spark, d), 30))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("overlap_5", "overlap_10", "rho")])


@query(
    "rank_shift",
    f"""{FUSED_SQL},
j AS (SELECT f.query_id, f.rank AS r, t.rank AS o FROM final f LEFT JOIN (SELECT * FROM top WHERE rank <= 30) t ON f.query_id = t.query_id AND f.key = t.key WHERE f.rank <= 30)
SELECT query_id, count(*) FILTER (WHERE r <= 5 AND (o IS NULL OR o > 5)) AS new_at_5, count(*) FILTER (WHERE r <= 10 AND (o IS NULL OR o > 10)) AS new_at_10,
       count(*) FILTER (WHERE r < o) AS promoted, count(*) FILTER (WHERE r > o) AS demoted FROM j GROUP BY query_id""",
)
def rank_shift(spark, d):
    return evaluate.rank_shift(vectors.top_k(A.vecs(spark, d), A.query_vecs(spark, d), 30), _fused(spark, d).where("rank <= 30"))


#: Feedback settings (alpha, k) compared, next to none.
GRID = [(0.5, 1), (0.5, 3), (0.7, 1), (0.7, 3), (0.8, 1), (0.8, 3), (0.9, 1), (0.9, 3), (0.9, 5)]


def _moved_sql(configs, lists, vectors, name):
    """Vectors of queries moved toward the mean of the first k of a list, for each configuration (alpha, k)."""
    return f"""{name}_e AS (SELECT c.alpha, c.k, t.query_id, unnest(range(1, len(v.vec) + 1)) AS i, unnest(v.vec) AS x FROM {configs} c JOIN {lists} t ON t.rank <= c.k AND coalesce(t.alpha, c.alpha) = c.alpha AND coalesce(t.k, c.k) = c.k JOIN vecs v ON v.key = t.key),
{name}_m AS (SELECT alpha, k, query_id, i, avg(x) AS x FROM {name}_e GROUP BY ALL),
{name}_b AS (SELECT c.alpha, c.k, query_id, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS qx FROM {configs} c JOIN {vectors} q ON coalesce(q.alpha, c.alpha) = c.alpha AND coalesce(q.k, c.k) = c.k),
{name}_l AS (SELECT alpha, k, query_id, list(alpha * qx + (1 - alpha) * x ORDER BY i) AS v FROM {name}_m JOIN {name}_b USING (alpha, k, query_id, i) GROUP BY ALL),
{name} AS (SELECT alpha, k, query_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vec FROM {name}_l),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY alpha, k, query_id ORDER BY score DESC, key) AS rank FROM (SELECT m.alpha, m.k, m.query_id, vecs.key, list_dot_product(m.vec, vecs.vec) AS score FROM {name} m, vecs))"""


def _configs_sql(grid):
    return "c AS (SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {k}::INT)" for a, k in grid) + ") AS c(alpha, k))"


OPEN_SQL = f"""{TOP_SQL}, own_q AS (SELECT NULL::DOUBLE AS alpha, NULL::INT AS k, query_id, vec FROM q), own_t AS (SELECT NULL::DOUBLE AS alpha, NULL::INT AS k, query_id, key, rank FROM top WHERE rank <= 30)"""

GRID_SQL = f"""{OPEN_SQL}, {_configs_sql(GRID)}, {_moved_sql("c", "own_t", "own_q", "moved")},
r AS (SELECT 'a=' || alpha || ',k=' || k AS label, query_id, key, rank FROM moved_r WHERE rank <= 10 UNION ALL SELECT 'none', query_id, key, rank FROM top WHERE rank <= 10),
rel AS (SELECT x.key AS query_id, y.key FROM vecs x JOIN vecs y ON x.label = y.label AND x.key <> y.key WHERE x.key % 50 = 0), sz AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
h AS (SELECT label, query_id, count(*) FILTER (WHERE rank <= 5) AS in5, count(*) AS in10, min(rank) AS f FROM r JOIN rel USING (query_id, key) GROUP BY ALL)
SELECT label, count(*) AS num_queries, round(avg(coalesce(in5 / n, 0)), 6) AS recall_at_5, round(avg(coalesce(in10 / n, 0)), 6) AS recall_at_10, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(CASE WHEN f = 1 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_1
FROM (SELECT DISTINCT label FROM r) JOIN sz ON true LEFT JOIN h USING (label, query_id) GROUP BY label"""


@query("feedback_grid", GRID_SQL)
def feedback_grid(spark, d):
    vecs = A.vecs(spark, d)
    return evaluate.feedback_grid(vecs.select("key", "vec"), A.query_vecs(spark, d), _by_label(vecs), GRID)


#: Vectors asked again, changed little, much or beyond recognition.
CHANGED_SQL = "list_transform(vec, lambda x, i: x * (1 + (key // 50 % 4) * 0.4 * ((key + i - 1) % 5 - 2)))"


@query(
    "reflect_scan",
    f"""WITH {A.VECS_SQL}, c AS (SELECT query_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vec FROM (SELECT key AS query_id, {CHANGED_SQL} AS v FROM vecs WHERE key % 50 = 0)),
s AS (SELECT query_id, v.key, list_dot_product(c.vec, v.vec) AS score FROM c, vecs v)
SELECT query_id, key, round(score, 6) AS top_match_similarity, CASE WHEN score > 0.9 THEN 'duplicate' WHEN score >= 0.7 THEN 'related' ELSE 'new' END AS route FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS n FROM s) WHERE n = 1""",
)
def reflect_scan(spark, d):
    """What is already known of each query: the table's vectors come again, as they are or changed."""
    i = F.pmod(F.col("key") + F.col("i"), F.lit(5)) - 2
    by = F.pmod(F.floor(F.col("key") / 50), F.lit(4)) * 0.4
    parts = A.vecs(spark, d).where("key % 50 = 0").select("key", F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x")).select("key", "i", (F.col("x") * (1 + by * i)).alias("x"))
    asked = parts.groupBy(F.col("key").alias("query_id")).agg(normalised(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])).alias("vec"))
    best = vectors.top_k(A.vecs(spark, d), asked, 1)
    route = F.when(F.col("score") > 0.9, "duplicate").when(F.col("score") >= 0.7, "related").otherwise("new")
    return best.select("query_id", "key", F.round("score", 6).alias("top_match_similarity"), route.alias("route"))


TUNED = [(0.5, 1), (0.5, 3), (0.7, 1), (0.7, 3), (0.9, 1), (0.9, 3)]

TUNED_SQL = f"""{OPEN_SQL}, {_configs_sql(TUNED)}, {_moved_sql("c", "own_t", "own_q", "moved")}, {_moved_sql("c", "moved_r", "moved", "twice")},
both_l AS (SELECT alpha, k, query_id, key, rank FROM moved_r WHERE rank <= 30 UNION ALL SELECT c.alpha, c.k, query_id, key, rank FROM top, c WHERE rank <= 30),
both_s AS (SELECT alpha, k, query_id, key, sum(1.0 / (5 + rank)) AS score FROM both_l GROUP BY ALL),
lists AS (SELECT 'replace' AS strategy, alpha, k, query_id, key, rank FROM moved_r UNION ALL SELECT 'two-pass', alpha, k, query_id, key, rank FROM twice_r
  UNION ALL SELECT 'hybrid', alpha, k, query_id, key, row_number() OVER (PARTITION BY alpha, k, query_id ORDER BY round(score, 12) DESC, key) FROM both_s),
j AS (SELECT l.*, t.rank AS o FROM lists l LEFT JOIN (SELECT * FROM top WHERE rank <= 30) t ON l.query_id = t.query_id AND l.key = t.key WHERE l.rank <= 30)
SELECT strategy, alpha, k, query_id, count(*) FILTER (WHERE rank <= 5 AND (o IS NULL OR o > 5)) AS new_at_5, count(*) FILTER (WHERE rank <= 10 AND (o IS NULL OR o > 10)) AS new_at_10, count(*) FILTER (WHERE rank < o) AS promoted, count(*) FILTER (WHERE rank > o) AS demoted FROM j GROUP BY ALL"""


@query("feedback_tuning", TUNED_SQL)
def feedback_tuning(spark, d):
    """Three strategies with six settings each, against no feedback."""
    return evaluate.feedback_strategies(A.vecs(spark, d).select("key", "vec"), A.query_vecs(spark, d), TUNED)


@query(
    "model_comparison",
    f"""WITH {A.VECS_SQL},
s AS (SELECT query_id, v.key, list_dot_product(q.vec, v.vec) AS one, list_dot_product(q.vec[1:32], v.vec[1:32]) AS two FROM q, vecs v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY one DESC, key) AS a, row_number() OVER (PARTITION BY query_id ORDER BY two DESC, key) AS b FROM s),
g AS (SELECT query_id, count(*) FILTER (WHERE a <= 5 AND b <= 5) / 5.0 AS o5, count(*) FILTER (WHERE a <= 10 AND b <= 10) / 10.0 AS o10,
      CASE WHEN count(*) < 2 THEN 0.0 ELSE 1 - 6.0 * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1)) END AS rho FROM r WHERE a <= 20 AND b <= 20 GROUP BY query_id)
SELECT q.query_id, round(coalesce(o5, 0), 6) AS overlap_5, round(coalesce(o10, 0), 6) AS overlap_10, round(coalesce(rho, 0), 6) AS rho FROM q LEFT JOIN g ON g.query_id = q.query_id""",
)
def model_comparison(spark, d):
    """Whole vectors against their first 32 numbers, as two models."""
    cut = lambda df: df.withColumn("vec", F.slice("vec", 1, 32))
    vecs, q = A.vecs(spark, d), A.query_vecs(spark, d)
    out = evaluate.compare_models((vecs, q), (cut(vecs), cut(q)))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("overlap_5", "overlap_10", "rho")])


@query(
    "pairs_ranked",
    f"{PAIRS_SQL} SELECT a, b, round(s, 6) AS similarity, row_number() OVER (ORDER BY round(s, 6) DESC, a, b) AS rank FROM pairs WHERE s >= {NEAR}",
)
def pairs_ranked(spark, d):
    found = vectors.similar_pairs(A.unit_vecs(spark, d), NEAR).withColumn("similarity", F.round("similarity", 6))
    # written: numbering reads it twice
    return lookup.numbered(written(found, "pairs"), F.desc("similarity"), F.asc("a"), F.asc("b"))


@query(
    "inbox_clusters",
    f"""{PAIRS_SQL}, t AS (SELECT doc_id AS key, [lang, source, 'n' || (doc_id % 3)] AS tags FROM documents)
SELECT a, b, round(s, 6) AS similarity, len(list_intersect(list_distinct(x.tags), list_distinct(y.tags)))::INT AS shared FROM pairs JOIN t x ON x.key = a JOIN t y ON y.key = b
WHERE s >= 0.3 AND len(list_intersect(list_distinct(x.tags), list_distinct(y.tags))) >= 2""",
)
def inbox_clusters(spark, d):
    tags = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.array("lang", "source", F.concat(F.lit("n"), F.col("doc_id") % 3)).alias("tags"))
    found = vectors.similar_pairs(A.unit_vecs(spark, d), 0.3, tags=tags, least=2)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("reflect_rerank")
def reflect_rerank(spark, d):
    """Hybrid candidates ranked again by shared words, with the cosine of each query's best match."""
    texts = _texts(spark, d)
    asked = models.embed(texts.select(F.col("query_id").alias("key"), "text"), "text", models.HashingEmbedder(64), query=True).select(F.col("key").alias("query_id"), "vec")
    found = fusion.reflected(_corpus(spark, d), texts, asked, models.OverlapScorer())
    return found.select("query_id", "key", F.round("score", 6).alias("score"), "rank", F.round("top_cosine", 6).alias("top_cosine"))
