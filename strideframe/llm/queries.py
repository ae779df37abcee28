"""Queries of the training-data operators, and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embdup, linedup, lmscore, mixing, neardup, negatives, packing, quality, sharding, substrings, tokenfile, urlfilter, variants


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_digest(_documents(spark, sf_dir))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_digest(_documents(spark, sf_dir))


def op5_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_scores(_documents(spark, sf_dir))


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_digest(spark, sf_dir)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_documents(spark, sf_dir))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), percent=85)


def op10_embdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negative_digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_digest(_documents(spark, sf_dir))


def op13_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digest(_documents(spark, sf_dir))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_linedup": op4_linedup,
    "op5_lmscore": op5_lmscore,
    "op6_tokenfile": op6_tokenfile,
    "op7_urlfilter": op7_urlfilter,
    "op8_sharding": op8_sharding,
    "op9_neardup": op9_neardup,
    "op10_embdup": op10_embdup,
    "op11_hardneg": op11_hardneg,
    "op12_spelling": op12_spelling,
    "op13_substring": op13_substring,
}
ORACLE_SQL = {
    "op1_mixing": mixing.SQL,
    "op4_linedup": linedup.SQL,
    "op7_urlfilter": urlfilter.SQL,
    "op11_hardneg": negatives.SQL,
    "op12_spelling": variants.SQL,
    "op13_substring": substrings.SQL,
}
