"""From raw documents to tokens: the stages of a training corpus, one after another.

Each stage works on all that the one before it kept. ``run`` writes its result as
Parquet in the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import bpe, language, mixing, quality, simhash
from weir.llm.common import drop_scratch, scratch, scratch_mark
from weir.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that was learned go."""
    return language.keep(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: linked by fingerprints, or by 0.8 of their five-word shingles."""
    return simhash.keep_one(docs, similarity=0.8)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.repeat(docs, mixing.mix(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they decode to."""
    coded = bpe.encode(docs, vocabulary(), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", dedup_stage),
    ("mix_sources", mix_stage),
    ("bpe_encoding", tokens_stage),
]

#: Neither the classifier nor the fingerprints can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's intermediate tables are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark, path = scratch_mark(), scratch(spark, name)
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        drop_scratch(spark, mark, path)
    return docs
