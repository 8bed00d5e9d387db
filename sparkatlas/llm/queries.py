"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import bpe, crf_quality, decontaminate, gated_lm, hard_negatives, importance, licenses, ngram_join, quality_rules, sharding, substring_dedup, suffix_array_dedup, winnowing
from sparkatlas.llm.common import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under a model of the documents that are not held out."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = gated_lm.score(docs)
    return out.select("doc_id", gated_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every text through the 49k word vocabulary."""
    import public_tokenizers

    return bpe.digest_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are alike."""
    return ngram_join.join(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every text once repeated passages are gone."""
    return substring_dedup.digest(_documents(spark, sf_dir))


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of two policies on every document, from one stored ledger."""
    entries = quality_rules.stored_ledger(_documents(spark, sf_dir))
    out = quality_rules.apply_policy(entries)
    failed, strict = quality_rules.fails(quality_rules.BASE_BITS), quality_rules.fails(quality_rules.STRICT.mask)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits", (~strict).alias("kept_strict"))


ORACLES["op5_quality_rules"] = quality_rules.oracle_sql()


@_query
def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the standard policy removes, by itself and alone, from the stored ledger."""
    return quality_rules.ablation(quality_rules.stored_ledger(_documents(spark, sf_dir)))


ORACLES["quality_ablation"] = quality_rules.ablation_sql()


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every text."""
    return decontaminate.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every text once strings that start earlier are gone."""
    return suffix_array_dedup.digest(_documents(spark, sf_dir))


@_query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    out = sharding.shard_documents(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


@_query
def shard_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored map of eight shards edited for nine: each slot's shard before and after."""
    path = fresh_path(spark, "slot-map")
    docs = _documents(spark, sf_dir)
    for n_shards in (8, 9):
        sharding.shard_documents(docs, n_shards, path=path)
    return sharding.changes(spark, path)


@_query
def op9_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from the labels that are not held out."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = crf_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = crf_quality.score(docs, model)
    return out.select("doc_id", crf_quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and statements in every text."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return licenses.summary(licenses.scan(docs))


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is moved on by one first."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = hard_negatives.oracle_sql()


@_query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses to that and to the next document."""
    return winnowing.compare(_documents(spark, sf_dir))


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn as the benchmark's texts would be."""
    out = importance.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_importance_resampling"] = importance.oracle_sql()
