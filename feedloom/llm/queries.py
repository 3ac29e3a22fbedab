"""The queries opN_<name> over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, licenses, linededup, merkle, mixing, neardup, oracles, pii, sharding, substrings, tokens, whitening
from .store import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of a folder's documents lives in the shared folder, from run to run."""
    path = f"{shared_dir(spark)}/feedloom/slot-map-{sha256(sf_dir.rstrip('/').encode()).hexdigest()[:16]}"
    return sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), map_path=path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, keep_text=False).select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write(read(spark, sf_dir, "documents").select("text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(read(spark, sf_dir, "documents").select(*merkle.FIELDS))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_line_dedup, op3_sharding, op4_language_id, op5_nearest_neighbours, op6_minhash_near_dedup,
        op7_token_shards, op8_license_scan, op9_mixing, op10_substring_dedup, op11_merkle_manifest, op12_pii, op13_embedding_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": oracles.DECONTAMINATION, "op2_line_dedup": oracles.LINES, "op6_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op9_mixing": mixing.ORACLE, "op10_substring_dedup": oracles.SUBSTRINGS, "op11_merkle_manifest": merkle.ORACLE,
}
