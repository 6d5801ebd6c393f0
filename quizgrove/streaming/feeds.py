"""Streams that keep a copy up to date. Every batch writes its own folder, so a repeated batch
replaces what its first attempt left and changes nothing else."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quizgrove.operators.replicate import latency_sketch, latest_per_key
from quizgrove.session import finished_numbers, remove_folder
from quizgrove.sources import changes as change_source

KEYS = ("snapshot_date", "student_id")
#: Folder of the rows whose table is not listed.
UNROUTED = "_unrouted_"


def _batch_path(root: str, batch_id: int) -> str:
    return f"{root}/rows/batch_id={batch_id}"


def _base_path(root: str, upto: int) -> str:
    return f"{root}/base/upto={upto}"


def _read_batches(spark: SparkSession, root: str, schema, after: int = -1, before: int | None = None) -> DataFrame:
    numbers = [n for n in finished_numbers(spark, f"{root}/rows/batch_id=") if n > after]
    paths = [_batch_path(root, n) for n in numbers if before is None or n < before]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def start(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None
) -> StreamingQuery:
    """Runs ``work`` per batch: every ``seconds``, or once over all that is there.

    Starting again on the same checkpoint resumes after the last finished batch.
    """
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def progress(query: StreamingQuery) -> dict[str, object]:
    """State of a running or finished stream."""
    last = query.lastProgress
    return {
        "active": query.isActive,
        "message": query.status["message"],
        "batch_id": None if last is None else last["batchId"],
        "input_rows": None if last is None else last["numInputRows"],
    }


# --- newest-per-key copy ---------------------------------------------------------------------


#: What a batch brought: a row per kind of record. ``op`` is null for unreadable ones.
PROGRESS = "op string, n_rows long, first_offset long, last_offset long, latest_ts_ms long, ts_sketch binary"
#: The operations of the feed; records with another one count as ``other``.
OPERATIONS = ("c", "u", "d", "r")


class BudgetError(ValueError):
    """More unreadable records than allowed."""


def upsert_batch(
    root: str, keys: Sequence[str] = KEYS, max_bad: int | None = change_source.MAX_BAD, table: str | None = None,
    compact_every: int | None = 100, load_budget: int | None = None,
):
    """Batch function of the upsert stream (C5): bad records aside, one row per key kept, its progress noted.

    A batch costs what it holds; the copy is not rewritten. After every ``compact_every`` batches ``compact`` folds
    them together, so that readers never meet more folders than two rounds of them. ``max_bad`` bounds the unreadable
    records of a batch, ``load_budget`` those of the whole load, batches before a restart included (S15). They are
    put aside before the batch is refused. A batch's progress is its last write, replaced if the batch is repeated.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = change_source.parsed(batch)
        if table is not None:
            rows = rows.filter(F.regexp_extract("topic", change_source.TOPIC, 3) == table)
        rows = rows.persist()  # counted, and written in two parts
        try:
            counts = _batch_counts(rows)
            bad = sum(row["n_rows"] for row in counts if row["op"] is None)
            change_source.quarantined(rows).write.mode("overwrite").parquet(f"{root}/bad/batch_id={batch_id}")
            _check_budget(spark, root, batch_id, bad, max_bad, load_budget)
            kept = latest_per_key(change_source.good(rows).drop("ok", "value", "topic"), keys)
            kept.write.mode("overwrite").parquet(_batch_path(root, batch_id))
            noted = spark.createDataFrame([tuple(row) for row in counts], PROGRESS)
            noted.coalesce(1).write.mode("overwrite").parquet(f"{root}/progress/batch_id={batch_id}")
        finally:
            rows.unpersist()
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(spark, root, batch_id, keys)

    return work


def _batch_counts(rows: DataFrame) -> list:
    """A batch's records by operation, in one pass: a handful of rows."""
    op = F.when(F.col("ok"), F.when(F.col("op").isin(*OPERATIONS), F.col("op")).otherwise("other"))
    measures = [F.count("*").alias("n_rows"), F.min("kafka_offset").alias("first_offset"), F.max("kafka_offset").alias("last_offset")]
    sketch = F.when(F.count("ts_ms") > 0, latency_sketch(F.col("ts_ms"))).alias("ts_sketch")
    return rows.groupBy(op.alias("op")).agg(*measures, F.max("ts_ms").alias("latest_ts_ms"), sketch).collect()


def _check_budget(spark: SparkSession, root: str, batch_id: int, bad: int, max_bad: int | None, load_budget: int | None) -> None:
    if max_bad is not None and bad > max_bad:
        raise BudgetError(f"{bad} unreadable records in one batch, {max_bad} are allowed")
    if load_budget is not None:
        before = load_progress(spark, root).filter((F.col("batch_id") < batch_id) & F.col("op").isNull())
        held = before.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        if held + bad > load_budget:
            raise BudgetError(f"{held + bad} unreadable records in the load, {load_budget} are allowed")


def load_progress(spark: SparkSession, root: str) -> DataFrame:
    """batch_id, op and counts of every finished batch."""
    paths = [f"{root}/progress/batch_id={n}" for n in finished_numbers(spark, f"{root}/progress/batch_id=")]
    schema = f"{PROGRESS}, batch_id long"
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{root}/progress").schema(schema).parquet(*paths)


def load_totals(progress: DataFrame) -> DataFrame:
    """One row for the load: batches, good and bad rows, the last offset, rows per operation."""
    good = F.col("op").isNotNull()
    per_op = [F.coalesce(F.sum(F.when(F.col("op") == op, F.col("n_rows"))), F.lit(0)).alias(f"op_{op}") for op in (*OPERATIONS, "other")]
    return progress.agg(
        F.count_distinct("batch_id").alias("batches"),
        F.coalesce(F.sum(F.when(good, F.col("n_rows"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(~good, F.col("n_rows"))), F.lit(0)).alias("bad"),
        F.max("last_offset").alias("last_offset"),
        *per_op,
    )


def _state_schema(spark: SparkSession):
    empty = spark.createDataFrame([], "kafka_offset bigint, topic string, value string")
    return latest_per_key(change_source.parsed(empty).drop("ok", "value", "topic"), KEYS).schema


def current(spark: SparkSession, root: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The latest row of every key, deletes included with ``op='d'``."""
    schema = _state_schema(spark)
    bases = finished_numbers(spark, f"{root}/base/upto=")
    after = bases[-1] if bases else -1
    rows = _read_batches(spark, root, schema, after)
    if bases:
        rows = rows.unionByName(spark.read.schema(schema).parquet(_base_path(root, after)))
    return latest_per_key(rows, keys)


def compact(spark: SparkSession, root: str, upto: int, keys: Sequence[str] = KEYS) -> None:
    """Folds all finished batches up to ``upto`` into one table that readers prefer from then on.

    What the table before was made of is removed, and tables older than it; that table itself and the batches since
    stay for readers that have begun on them, and for a repeated call.
    """
    schema = _state_schema(spark)
    found = finished_numbers(spark, f"{root}/base/upto=")
    if found and found[-1] > upto:
        return  # a newer table holds these batches
    bases = [n for n in found if n < upto]
    after = bases[-1] if bases else -1
    rows = _read_batches(spark, root, schema, after, upto + 1)
    if bases:
        rows = rows.unionByName(spark.read.schema(schema).parquet(_base_path(root, after)))
    latest_per_key(rows, keys).write.mode("overwrite").parquet(_base_path(root, upto))
    for number in bases[:-1]:
        remove_folder(spark, _base_path(root, number))
    for number in finished_numbers(spark, f"{root}/rows/batch_id="):
        if number <= after:
            remove_folder(spark, _batch_path(root, number))


def with_snapshot(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Latest rows of an initial snapshot (operation ``r``) and the changes after it."""
    first = snapshot.withColumn("op", F.lit("r")).withColumn("ts_ms", F.lit(0).cast("bigint"))
    first = first.withColumn("kafka_offset", F.lit(-1).cast("bigint"))
    return latest_per_key(first.unionByName(changes, allowMissingColumns=True), keys)


def _table_path(root: str, batch_id: int) -> str:
    return f"{root}/tables/batch_id={batch_id}"


def split_tables(root: str, tables: Sequence[str]):
    """Batch function that routes a multi-table feed to one folder per table.

    Rows of tables not listed go to ``UNROUTED`` with their table's name, so that no row is lost whose offset counts
    as read. The batch is read once and written once, partitioned by where its rows go.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        listed = F.coalesce(F.col("table").isin(*tables), F.lit(False))
        rows = change_source.routed(batch).withColumn("goes_to", F.when(listed, F.col("table")).otherwise(UNROUTED))
        rows.write.mode("overwrite").partitionBy("goes_to").parquet(_table_path(root, batch_id))

    return work


def _routed_rows(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of one folder in each finished batch; other tables' folders are pruned."""
    paths = [_table_path(root, n) for n in finished_numbers(spark, f"{root}/tables/batch_id=")]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{root}/tables").schema(f"{schema}, batch_id long, goes_to string").parquet(*paths)
    return rows.filter(F.col("goes_to") == name).drop("batch_id", "goes_to")


def table_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _routed_rows(spark, root, name, "kafka_offset bigint, topic string, value string")


def unrouted_rows(spark: SparkSession, root: str) -> DataFrame:
    return _routed_rows(spark, root, UNROUTED, "table string, kafka_offset bigint, topic string, value string")
