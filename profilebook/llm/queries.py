"""The registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilebook.llm import exact, fingerprint, html, langid, linedup, merkle, minhash, mixing, quality, sharding, spm, toxicity, variants
from profilebook.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of four words (the contract's width), 100 * intersection >= 80 * union."""
    return minhash.near_groups(read(spark, sf_dir, "documents"), width=4, percent=80)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(read(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.places(read(spark, sf_dir, "documents")).drop("row_no")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents")).drop("n_chunks")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc.doc_id", "n_lines", "n_removed", "emptied", "text")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.token_table(read(spark, sf_dir, "documents"), piece=3_000_000)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read(spark, sf_dir, "documents"))


def op12_consistent_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the 40 shards are at most one apart."""
    return sharding.shards_of(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_minhash_near_dedup, op3_html_extraction, op4_source_mixing, op5_language_id,
                                   op6_exact_dedup, op7_line_dedup, op8_sentencepiece, op9_fingerprints, op10_quality,
                                   op11_spelling_variants, op12_consistent_sharding, op13_merkle_manifest)}

ORACLE_SQL = {"op6_exact_dedup": exact.ORACLE, "op7_line_dedup": linedup.ORACLE, "op11_spelling_variants": variants.ORACLE,
              "op12_consistent_sharding": sharding.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
