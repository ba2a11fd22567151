"""Queries of this subpackage, each applying an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, fingerprints, langid, licences, mixing, passages, pieces, rules, setjoin, suffixes

#: where the tokenizers' files lie; a parameter of the deployment
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    profiles = langid.fit(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).drop("text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    names = {"mix_size": "size", "mix_source_size": "source_size", "mix_target": "target", "mix_taken": "taken"}
    return mixed.select("doc_id", *[F.col(a).alias(b) for a, b in names.items()], F.array_join(F.col("mix_shards").cast("array<string>"), ",").alias("shards"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(documents(spark, sf_dir))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(documents(spark, sf_dir)).drop("matches")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = compression.fit(docs, labels.where(~held_out))
    return compression.score(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), piece_model_path(), ids=False, spans=False)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_license_scans": op6_license_scans,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE: dict[str, str] = {"op3_mixing": mixing.ORACLE}
