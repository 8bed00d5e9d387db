"""The corpus pipeline: stages over documents, each calling one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import bpe, decontaminate, ngram_join, quality_rules, substring_dedup
from sparkatlas.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as its text now has them."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the standard policy rejects go."""
    return quality_rules.keep(docs.select(*COLUMNS))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words and 0.8: of each group of near-duplicates the one of least id stays."""
    return ngram_join.one_of_each(docs.select(*COLUMNS), size=5, percent=80)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages that occur anywhere else are cut."""
    return _counted(substring_dedup.remove_passages(docs.select(*COLUMNS)))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: benchmark text is cut, documents mostly made of it go."""
    return _counted(decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: doc_id, n_tokens, the ids (little-endian unsigned 32 bit) and the text they decode to."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_join", keep_one_of_each),
    ("substring_dedup", cut_passages),
    ("decontaminate", cut_benchmark),
    ("bpe", encode),
]
#: SQL can't express the whole of it; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
