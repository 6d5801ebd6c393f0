"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir). All but the last return rows of ``docs`` with their columns; the last
returns what it reads back from the token files it wrote.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quizgrove.llm import decontaminate, mixing, quality, simhash, token_files
from quizgrove.llm.common import load
from quizgrove.llm.queries import TOKENIZER
from quizgrove.session import new_folder, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep.

    Null and empty texts have no words and go. Texts of any length are counted whole. Repeated rows and rows with equal scores
    fare alike; extra columns are kept; an empty table stays empty.
    """
    return quality.kept_documents(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Null, empty and blank texts have the fingerprint zero and are one group. Of a group the least document id stays (null
    last), and of rows that share it one. Texts of any length are hashed whole; an empty table stays empty.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a phrase of the benchmark.

    Null and empty texts hold none and stay, as do repeated rows each for itself. Texts of any length are searched whole. An
    empty benchmark keeps all rows; an empty table stays empty.
    """
    return decontaminate.clean_documents(docs, load(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no size and are not taken. A null source is a source of its own, the last. Equal keys are told apart
    by id and text, so that reruns agree; repeated rows are drawn alike. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the token files.

    Null and empty texts have the end id only. Rows with a null id come first, rows that share an id follow each other, and
    each row is written, whatever the length of its text. An empty table gives no rows.
    """
    folder = new_folder(spark, "pipeline-tokens")
    token_files.write_tokens(docs, public_tokenizers.path(TOKENIZER), folder)
    return token_files.token_digests(spark, folder)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
    ("token-ID output", token_output),
]

#: Trees, XXH64 fingerprints and token ids have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result written to shared storage and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
