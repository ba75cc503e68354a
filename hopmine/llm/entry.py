"""The queries of this subpackage, one per operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_dedup, fingerprints, merkle, mixing, ngram_join, piece_bpe, secrets_scan, sharding, substring_dedup, token_counts, toxicity, warc


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secret_spans(_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_documents(spark, sf_dir), toxicity.train_from(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_passages(_documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked_manifest(_documents(spark, sf_dir))


WARC_ORACLE = """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha256(coalesce(html, '')) payload_digest from pages
), f as (
  select *, min(page_id) over (partition by payload_digest) first_id from p
)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end refers_to
from f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_source_mixing, op3_exact_dedup, op4_fingerprints, op5_sentencepiece, op6_sharding, op7_ngram_join, op8_token_counts, op9_secret_scan, op10_toxicity, op11_alignment, op12_substring_dedup, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC_ORACLE, "op2_source_mixing": mixing.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
