"""The corpus pipeline: quality rules, toxicity, near duplicates, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontam, jaccard, packing, quality, tokens, toxicity
from quillstone.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The model learns from ``labels`` over the table of all documents."""
    return quality.with_quality(docs, quality.trained(spark, sf_dir)).where("kept").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic. The model learns from ``labels`` over the table of all documents."""
    return toxicity.with_toxicity(docs, toxicity.trained(spark, sf_dir)).where("predicted = 0").select(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a 5-word shingle similarity of 0.8 or more, that with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 or more of its 5-word shingles)."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its place in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokens.tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: None of the trained stages can be written in SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
