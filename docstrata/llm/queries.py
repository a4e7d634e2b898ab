"""The registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm import (
    hamming_search,
    large_item_packing,
    line_dedup,
    ngram_join,
    ordinal_classifier,
    packing,
    periodic_runs,
    quality_rules,
    sentencepiece_codec,
    sharding,
    spelling_variants,
    substring_dedup,
    training_order,
)
from docstrata.llm.common import ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(fn)
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = shipped
    return shipped


@query
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.token_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, folder, "documents"))


@query
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels").where("quality is not null and toxic is not null")
    model = ordinal_classifier.train(docs, labels.select("doc_id", ordinal_classifier.grade(F.col("quality"), F.col("toxic")).alias("grade")))
    scored = ordinal_classifier.score_documents(docs, model)
    return scored.select(
        "doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("top_probability", 6).alias("top_probability"), (F.col("top_probability") > 0.5).alias("kept")
    )


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.passage_digests(table(spark, folder, "documents"))


@query
def op5_hamming_search(spark: SparkSession, folder: str) -> DataFrame:
    return hamming_search.search_vectors(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_decisions(table(spark, folder, "documents"))


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shard_documents(table(spark, folder, "documents").select("doc_id", "text"))
    text = F.coalesce("record.text", F.lit(""))
    return sharded.select(
        "record.doc_id",
        (F.octet_length(text).cast("long") + sharding.RECORD_OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_training_order(spark: SparkSession, folder: str) -> DataFrame:
    target = training_order.new_folder(spark)
    return training_order.write_training_order(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), target)


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge_documents(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior")
    )


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return large_item_packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts of the contract: one id in ten repeats a stretch of its words up to the end."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")).alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.expr("h div 10")
    kept = F.when(n > 0, g % n).cast("int")
    period = (1 + F.floor((n - kept) / (3 + g % 8))).cast("int")
    times = F.ceil((n - kept) / period).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("words", kept + 1, period), times))
    text = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), kept), repeated), F.lit(1), n), " ")
    return docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digests(with_planted_runs(table(spark, folder, "documents")))


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling_variants.count_words(table(spark, folder, "documents"), slip_every=199)
    return spelling_variants.group_variants(words)
