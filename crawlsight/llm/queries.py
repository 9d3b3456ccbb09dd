"""The registered queries of this subpackage; each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (binary_output, bpe, brown_lm, collocations, decontamination, exact_dedup, quality_classifier, quality_rules, secret_scan,
               simhash, ss_packing, url_filter, whitening)
from .common import documents, labels, learns


BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_BPE, WORD_BPE_IDS = "word_bpe_49k.json", 49408


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(BYTE_RANKS)
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss_packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


URL_RULES = [url_filter.UrlRule(v, r) for v, r in (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"))]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "blocked_share")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return secret_scan.scan(docs, secret_scan.scanner_of(docs, path_col="source"), path_col="source")


def op7_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    in_training = learns(F.col("doc_id"), 7, 2)
    model, counts = brown_lm.train(docs.filter(in_training))
    return brown_lm.score(docs, model, counts).select(
        "doc_id", (~in_training).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
        "score", "perplexity")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    in_training = learns(F.col("doc_id"), 3, 1)
    space = quality_classifier.build_space(docs)
    network = quality_classifier.fit(docs, labels(spark, sf_dir).filter(in_training), space)
    scores = quality_classifier.score(docs, space, network)
    space.drop()
    return scores.select(
        "doc_id", (~in_training).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.packed_matrices(
        documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), WORD_BPE_IDS)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.scratch_index(spark)
    rows = exact_dedup.judged(exact_dedup.digests(documents(spark, sf_dir)), index, "documents")
    index.drop()
    return rows


def op11_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(documents(spark, sf_dir), items).drop("item_ids")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.whiten(vectors, whitening.fit(vectors))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_byte_bpe, op3_simhash_near_dedup, op4_best_fit_packing, op5_url_filter,
    op6_secret_scan, op7_brown_class_lm, op8_quality_classifier, op9_token_id_output, op10_exact_dedup,
    op11_phrase_collocation, op12_benchmark_decontamination, op13_embedding_whitening)}
