"""Token counts through a cache of digests (operator 1).

A text's key is the SHA-256 of its normalised content (null is the empty text; nothing else may change, as
it would change the count) beside the digest of the tokenizer's version. Counts are stored by that key in a
Parquet table; only different texts without a stored count are encoded, and their counts are appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizgrove.llm.tokenizing import TokenizerFile
from quizgrove.session import saved

CACHE_SCHEMA = "digest binary, n_tokens long, version string"


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """Stored counts of one version, one row a digest even if two runs have appended the same."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of each row.

    ``cache`` is a folder in shared storage that may not exist yet. Null texts count as empty: no bytes, no
    tokens. Every row is returned, repeated rows and null ids too; an empty table gives no rows. Other
    columns of ``docs`` are not read. Each copy of a text gets its count by a join on the digest, in which
    Spark splits the rows of a hot digest; copies are reduced in each task before texts are shuffled, so that
    a task sends a text once. A text of any length is hashed and encoded whole.
    """
    spark = docs.sparkSession
    file = TokenizerFile.read(spark, tokenizer)
    content = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    different = texts.groupBy("digest").agg(F.first("content").alias("content"))
    # a left join: Spark would carry an anti join, and so all copies, below the aggregate
    held = read_cache(spark, cache, file.version).select("digest", F.lit(True).alias("held"))
    misses = different.join(held, "digest", "left").filter("held IS NULL").drop("held")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = file.encoder()
        for batch in batches:
            counts = pa.array(encoder.counts(batch.column("content")), type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], ["digest", "n_tokens"])

    new = misses.mapInArrow(encode, "digest binary, n_tokens long").withColumn("version", F.lit(file.version))
    new.write.mode("append").partitionBy("version").parquet(cache)
    rows = docs.select(
        "doc_id",
        F.octet_length(content).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
    )
    # saved, so that the join stands alone between its shuffles and Spark may split a hot digest
    stored = saved(read_cache(spark, cache, file.version), "stored-counts")
    counted = rows.join(stored, "digest", "left")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
