"""From raw documents to packed sequences: rules, classifier, near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import common, jaccard_join, packing, quality_classifier, quality_rules, substring_dedup, tokens


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality_rules.filter_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.filter_documents(docs, common.read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 over five-word shingles."""
    return jaccard_join.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return substring_dedup.cut_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, and their sequence and place in it."""
    return packing.pack(docs, tokens.byte_bpe_path(), with_ids=True)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("jaccard_join", near_copies), ("substring_dedup", passages), ("packing", sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read again, so a lost executor costs one stage at most."""
    work = common.Workspace(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    work.drop(*(name for name, _ in STAGES[:-1]))
    return docs
