"""One query per operator over its whole table, as registered by the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe,
    centroids,
    decontaminate,
    fingerprint,
    hard_negatives,
    language_id,
    licenses,
    lm_score,
    near_dedup,
    quality,
    secrets,
    token_files,
    toxicity,
)
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that aren't held out."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and their decoding, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketch of every document, and its likeness to an edited text and to the next document."""
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to files and read back from them."""
    import public_tokenizers

    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by documents: (doc_id, item_id, matched, n_shingles, containment)."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document, learnt from the documents that aren't held out."""
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document: (doc_id, class_id)."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that aren't held out."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document; its place is a folder of its source by 64 ids, under one by 4,096."""
    folders = [F.col("source"), F.floor(F.col("doc_id") / 4096), F.floor(F.col("doc_id") / 64), F.col("doc_id")]
    path = F.concat_ws("/", *[f.cast("string") for f in folders])
    return licenses.scan(table(spark, sf_dir, "documents"), path)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every usable vector after ten rounds, with the inertia of its cluster and of all."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every anchor and each of its positives."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels that aren't held out."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_fingerprint": op3_fingerprint,
    "op4_token_files": op4_token_files,
    "op5_decontaminate": op5_decontaminate,
    "op6_secrets": op6_secrets,
    "op7_lm_score": op7_lm_score,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_centroids": op11_centroids,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_toxicity": op13_toxicity,
}

ORACLES = {
    "op5_decontaminate": decontaminate.oracle(),
    "op11_centroids": centroids.oracle(),
    "op12_hard_negatives": hard_negatives.oracle(),
}
