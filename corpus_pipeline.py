"""From documents to training sequences, in written stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents. A stage's result is
written and read again before the next one starts, so a lost executor costs
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import linedup, mixing, neardup, packing, quality
from strideframe.llm.common import WorkTables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram importance reject go."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from texts, but for their first document."""
    return linedup.drop_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at Jaccard 0.8 stays."""
    return neardup.drop_near_duplicates(docs, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated, so that sources meet their target shares."""
    return mixing.mix_sources(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mixing", source_mixing),
    ("packing", sequence_packing),
]

#: The quality model, sketches and tokenizers are beyond SQL; tests compare each operator with brute force, and the stages by their columns and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = WorkTables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return tables.save(STAGES[-1][1](spark, docs, sf_dir), "packed")
