"""The corpus pipeline: documents that stay, without secrets, packed into sequences.

STAGES names five stages; each takes (spark, docs, sf_dir), docs being what the stage before kept as a
table, and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import common
from cladeframe.llm.decontamination import contamination
from cladeframe.llm.near_dedup import near_duplicates
from cladeframe.llm.packing import best_fit_packing
from cladeframe.llm.quality_classifier import quality
from cladeframe.llm.secret_scan import redact


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled ones among docs. Null and empty texts are judged by their structure;
    a row without doc_id stays, repeated rows go or stay together, an empty table stays empty."""
    scored = common.keep(quality(docs, common.load(spark, sf_dir, "labels"), metadata=["n_chars"]), "scored")
    return common.decided(docs, scored.where("predicted = 0"), "left_anti")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of least doc_id. Texts without words and rows without doc_id stay; rows that
    repeat a doc_id stay together if theirs is the least."""
    gone = common.keep(near_duplicates(docs).where("NOT kept").select("doc_id"), "gone")
    return common.decided(docs, gone, "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; a row without doc_id can't be named and stays."""
    found = common.keep(contamination(docs, common.load(spark, sf_dir, "benchmark")), "contaminated")
    return common.decided(docs, found, "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are overwritten and n_chars, where that column is, is counted again. Null texts stay null."""
    out = redact(docs)
    if "n_chars" not in docs.columns:
        return out
    rows, n, text = common.plain(out), f"_in{common.place(out, 'n_chars')}", f"_in{common.place(out, 'text')}"
    return rows.withColumn(n, F.length(text).cast(rows.schema[n].dataType)).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place. A null or empty text is its end alone; equal lengths are told apart by doc_id
    and place; an empty table gives no pieces."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", packing),
]

# Learnt weights, hashed sketches and a tokenizer are beyond SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again."""
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
