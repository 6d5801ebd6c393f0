"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quizgrove.llm import (
    centroids,
    decontaminate,
    line_spread,
    mixing,
    passages,
    piece_texts,
    quality,
    ranked_search,
    simhash,
    substring,
    token_counts,
    token_files,
    url_rules,
    warc,
)
from quizgrove.llm.common import load
from quizgrove.llm.oracles import ORACLE  # noqa: F401
from quizgrove.session import new_folder

TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 1024


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path(TOKENIZER), new_folder(spark, "token-counts"), TOKEN_LIMIT)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_files.write_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), folder)
    return token_files.token_digests(spark, folder)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_table(load(spark, sf_dir, "documents"))


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside op3, whose lines are those of its SQL: repeated passages in short lines and inside long ones too."""
    return passages.passage_table(load(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.line_table(load(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(load(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archive")
    warc.write_archive(load(spark, sf_dir, "pages"), folder)
    found = warc.capture_index(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(load(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_table(load(spark, sf_dir, "embeddings"))


def op13_piece_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_texts.piece_table(load(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    function.__name__: function
    for function in (
        op1_token_counts, op2_token_files, op3_substring_dedup, op4_decontamination, op5_line_spread, op6_simhash,
        op7_url_rules, op8_warc, op9_mixing, op10_quality, op11_ranked_search, op12_centroids, op13_piece_texts, passage_dedup, pipeline,
    )
}
