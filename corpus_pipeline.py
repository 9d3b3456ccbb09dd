"""A training-data pipeline over `documents`: quality rules, exact and near deduplication, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crawlsight.llm import exact_dedup, quality_rules, secret_scan, simhash, ss_packing
from crawlsight.llm.common import documents, labels
from crawlsight.llm.queries import WORD_BPE
from crawlsight.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learnt rules keep."""
    return quality_rules.keep(docs, labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, by an index of this run alone."""
    index = exact_dedup.scratch_index(spark)
    kept = exact_dedup.dedup(docs, index, "documents")
    index.drop()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars renewed where a text has changed."""
    scanner = secret_scan.scanner_of(docs, path_col="source")
    return secret_scan.redact(docs, scanner, path_col="source", length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return ss_packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("secret_scan", secrets), ("best_fit_packing", pack)]

# the learnt stages and the tokeniser have no SQL; tests compare the stages with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on what the one before it has written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
