"""The driver's queries over the operators of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql import ORACLE_SQL  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    counted = token_counts(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup_digests

    return dedup_digests(read(spark, sf_dir, "documents"), length=100)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_hits

    return license_hits(read(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import benchmark_hits

    return benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), shards=8)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), length=1024, added=True)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality, op3_ngram_jaccard, op4_suffix_dedup, op5_license_scan, op6_embedding_dedup, op7_language_id, op8_decontamination, op9_sharding, op10_packing)}
