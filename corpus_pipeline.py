"""A corpus pipeline: quality, near copies, benchmark leaks, secrets, tokens. Each stage's result is written and read again as the next one's documents.

Null and empty texts count as empty in every stage: they are judged like others, are no near copies of each other, leak and hide
nothing and have no tokens. Rows with a null doc_id stay in all stages but the first, which judges them like others. Repeated rows are
copies, of which one stays. Very long texts are worked off whole. Empty tables give empty results. Columns of documents stay as
they are, others too, but those that the last stage adds (ids, n_tokens, decodes) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklight.llm import bpe, common, decontamination, ngram_join, quality, secrets
from tracklight.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two views together accept."""
    return quality.keep_accepted(docs, common.table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.keep_one(docs, common.Scratch(spark))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids, and whether these decode to the bytes of the text."""
    return bpe.encode_checked(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secret_scans),
    ("byte-level BPE", tokens),
]

#: Trained models, hashing and tokens can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, which are computed from the table of the stage before when they are asked for. Tables of earlier stages are removed as soon as the next one is written."""
    docs, between = common.table(spark, sf_dir, "documents"), common.Scratch(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = between.save(stage(spark, docs, sf_dir), str(k))
        between.keep(str(k))
    return STAGES[-1][1](spark, docs, sf_dir)
