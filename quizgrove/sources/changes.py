"""Change events: source, routing, parsing and bad records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Batch limits of the feed.
MAX_ROWS = 100_000
BATCH_SECONDS = 10
MAX_BAD = 100

#: Fixed value: how long the broker keeps records, and so how late one can be delivered again.
RETENTION = "168 hours"
ARRIVED = "arrived_at"

WARNING_SCHEMA = """snapshot_date string, student_id string, attendance_rate string, submit_rate string,
 violation_cnt int, core_fail_cnt int, risk_level string, __op string, op string, __ts_ms bigint, ts_ms bigint,
 __source_db string, __source_table string, __deleted string"""
TOPIC = r"([^.]+)\.([^.]+)\.([^.]+)"


def kafka_options(servers: str, topics: str, max_rows: int = MAX_ROWS) -> dict[str, str]:
    """Options of the change feed, read from its beginning in bounded batches."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topics,
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": str(max_rows),
    }


def kafka_changes(spark: SparkSession, servers: str, topics: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """The change feed as (kafka_offset, topic, value), each record once."""
    feed = spark.readStream.format("kafka").options(**kafka_options(servers, topics, max_rows)).load()
    feed = delivered_once(feed, ("topic", "partition", "offset"))
    return feed.select(F.col("offset").alias("kafka_offset"), "topic", F.col("value").cast("string").alias("value"))


def file_changes(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """The same columns from Parquet files as they arrive."""
    schema = "kafka_offset bigint, topic string, value string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def delivered_once(changes: DataFrame, keys: Sequence[str] = ("topic", "kafka_offset"), expiry: str = RETENTION) -> DataFrame:
    """The feed without records delivered before (C5): a keyed state remembers each place for ``expiry``.

    The state's clock is the time of arrival, the same for all records of a batch and kept with its offsets, so no
    record is ever too late and none is lost; a record delivered again after more than ``expiry`` passes, and the
    merge by key makes it harmless. Feeds whose places are per partition name it in ``keys``.
    """
    return changes.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, expiry).dropDuplicatesWithinWatermark(list(keys)).drop(ARRIVED)


def routed(changes: DataFrame) -> DataFrame:
    """Adds the table name a topic ``server.database.table`` stands for."""
    return changes.withColumn("table", F.regexp_extract("topic", TOPIC, 3))


def wire_date(text: Column) -> Column:
    """A date from days since 1970-01-01 or from ISO text."""
    return F.coalesce(F.date_add(F.lit("1970-01-01").cast("date"), text.try_cast("int")), text.try_cast("date"))


def parsed(changes: DataFrame) -> DataFrame:
    """Typed warning rows with change attributes; ``ok`` is false for unreadable records."""
    rows = changes.withColumn("r", F.from_json("value", WARNING_SCHEMA, {"mode": "PERMISSIVE"}))
    op = F.coalesce("r.__op", "r.op")
    return rows.select(
        "kafka_offset",
        "topic",
        "value",
        wire_date(F.col("r.snapshot_date")).alias("snapshot_date"),
        F.col("r.student_id").alias("student_id"),
        F.col("r.attendance_rate").try_cast("decimal(5,4)").alias("attendance_rate"),
        F.col("r.submit_rate").try_cast("decimal(5,4)").alias("submit_rate"),
        F.col("r.violation_cnt").alias("violation_cnt"),
        F.col("r.core_fail_cnt").alias("core_fail_cnt"),
        F.col("r.risk_level").alias("risk_level"),
        F.when(F.col("r.__deleted") == "true", "d").otherwise(op).alias("op"),
        F.coalesce("r.__ts_ms", "r.ts_ms").alias("ts_ms"),
        F.col("r.__source_db").alias("source_db"),
        F.col("r.__source_table").alias("source_table"),
    ).withColumn("ok", F.col("student_id").isNotNull() & F.col("snapshot_date").isNotNull())


def _enveloped(changes: DataFrame, row_schema: str) -> DataFrame:
    """The feed with its envelopes as ``e``; ``ok`` is false for those without an operation or a row image.

    Tombstones (a NULL value) carry nothing and are dropped.
    """
    envelope = f"before struct<{row_schema}>, after struct<{row_schema}>, op string, ts_ms bigint, " \
        "source struct<db:string,`table`:string>"  # fmt: skip
    rows = changes.filter(F.col("value").isNotNull()).withColumn("e", F.from_json("value", envelope))
    image = F.coalesce("e.after", "e.before")
    return rows.withColumn("ok", F.coalesce(F.col("e.op").isNotNull() & image.isNotNull(), F.lit(False)))


def unwrapped(changes: DataFrame, row_schema: str) -> DataFrame:
    """Rows of full change envelopes: the after image, or the before image of a delete.

    Unreadable envelopes are not among them: ``bad_envelopes`` has them.
    """
    return _enveloped(changes, row_schema).filter("ok").select(
        "kafka_offset",
        F.inline(F.array(F.coalesce("e.after", "e.before"))),
        F.col("e.op").alias("op"),
        F.col("e.ts_ms").alias("ts_ms"),
        F.col("e.source.db").alias("source_db"),
        F.col("e.source.table").alias("source_table"),
        (F.col("e.op") == "d").alias("deleted"),
    )


def bad_envelopes(changes: DataFrame, row_schema: str) -> DataFrame:
    """Records that are no envelope, or one without an operation or a row image, as they came."""
    return _enveloped(changes, row_schema).filter("NOT ok").select(*changes.columns)


def good(rows: DataFrame) -> DataFrame:
    return rows.filter("ok")


def quarantined(rows: DataFrame) -> DataFrame:
    """Unreadable records with their place in the feed."""
    return rows.filter(~F.col("ok")).select("kafka_offset", "topic", "value")


def check_bad(rows: DataFrame, limit: int = MAX_BAD) -> None:
    """Raises when a batch holds more unreadable records than allowed."""
    bad = quarantined(rows).limit(limit + 1).count()
    if bad > limit:
        raise ValueError(f"more than {limit} unreadable records in one batch")
