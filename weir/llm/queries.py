"""The queries of this subpackage: each applies one operator to its whole table.

Every function takes (spark, folder of the tables) and returns the digest columns
that its contract names, derived from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, licenses, media, mixing, pages, quality, sharding, simhash, topk

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards, counts at most one apart."""
    placed = sharding.shard(_table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and classes of all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def vocabulary() -> str:
    """The byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and their texts decoded again, as digests."""
    coded = bpe.encode(_table(spark, sf_dir, "documents"), vocabulary(), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best answers to every fiftieth vector, among all others."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as WAV files, read back and fingerprinted, as digests."""
    loaded = media.load(media.store(_table(spark, sf_dir, "documents")))
    tail = F.expr("substring(payload, greatest(length(payload) - 31, 1), 32)")
    prints = F.lpad(F.lower(F.hex(F.xxhash64("print_frames", "print_codes"))), 16, "0")
    return loaded.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "frames", F.size("print_codes"), prints).alias("feature"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license text or notice in all documents, with its coverage."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    found = pages.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = (
    op1_consistent_hash_sharding,
    op2_simhash_near_dedup,
    op3_bpe_round_trip,
    op4_quality_classifier,
    op5_exact_top_k,
    op6_language_id,
    op7_media_columns,
    op8_license_scan,
    op9_html_extraction,
    op10_entropy_balanced_mix,
)

#: DuckDB SQL of the queries that SQL can express.
ORACLES = {
    "op5_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id, list_transform(min(d), lambda x: floor(256 * x)) AS e
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS d FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL)
  WHERE len(list_filter(d, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
