"""Documents through quality rules, quality classifier, near-duplicate removal and packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import line_crf, near_dedup, packing, quality_rules
from cellweave.llm.common import ROW_GROUP, delete, small_scans, table
from cellweave.plans.lineage import scratch


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules reject go."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model calls bad go. It is fitted on labelled documents of the source table."""
    return line_crf.filter_documents(spark, docs, sf_dir)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays. Pairs of texts go to Python workers few at a time: what workers
    and executors took for large batches would count against the next stage too."""
    with small_scans(spark):
        return near_dedup.deduplicated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: packing and the line model have no SQL form; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what a stage read goes when the next one
    is written."""
    docs, base, last = table(spark, sf_dir, "documents"), scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with small_scans(spark):
            out.write.option("parquet.block.size", ROW_GROUP).parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
        if last:
            delete(spark, f"{base}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
