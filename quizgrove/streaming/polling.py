"""The high-water-mark copy (C2, C4) as a target in date folders with a commit log.

Each poll writes its rows to ``data/part=<date>/folder=<poll>`` and then one small record per touched date to
``log/batch_id=<n>``: date, folder, rows and the mark (the newest date copied so far). A poll takes its mark
from the newest record and reads of the target only the folders of dates from the mark on; older dates are neither
listed nor read. Only folders named in the log count, so what a failed poll left behind is not seen, and a
repeated poll that finished before changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quizgrove.operators.replicate import missing_rows, one_per_key
from quizgrove.session import finished_numbers, remove_folder

LOG = "part date, folder string, rows long, mark date"
#: What Spark names the folder of rows whose partition value is null (fixed value).
NULL_PART = "__HIVE_DEFAULT_PARTITION__"
#: The number of the first content in the log.
FIRST = 0


@dataclass(frozen=True)
class Target:
    """Where a copy lies, its columns, the date column that marks progress, its keys, and the span of a folder."""

    root: str
    schema: StructType
    column: str
    keys: tuple[str, ...]
    grain: str = "day"

    def part(self) -> Column:
        return F.trunc(F.to_date(self.column), self.grain) if self.grain != "day" else F.to_date(self.column)


@dataclass(frozen=True)
class Folder:
    """A folder of the copy that the log names."""

    part: dt.date | None
    name: str

    def path(self, target: Target) -> str:
        return f"{target.root}/data/part={self.part or NULL_PART}/folder={self.name}"


def _numbers(spark: SparkSession, target: Target) -> tuple[int | None, list[int]]:
    """The newest base of the log, and the finished polls after it."""
    bases = finished_numbers(spark, f"{target.root}/log_base/upto=")
    base = bases[-1] if bases else None
    return base, [n for n in finished_numbers(spark, f"{target.root}/log/batch_id=") if base is None or n > base]


def _records(spark: SparkSession, target: Target, before: int | None = None) -> DataFrame | None:
    """The log: the newest base and the records after it, up to a poll."""
    base, numbers = _numbers(spark, target)
    paths = [] if base is None else [f"{target.root}/log_base/upto={base}"]
    paths += [f"{target.root}/log/batch_id={n}" for n in numbers if before is None or n < before]
    return spark.read.schema(LOG).parquet(*paths) if paths else None


def mark(spark: SparkSession, target: Target) -> dt.date | None:
    """The newest date copied, from the newest record alone (A7); None while nothing is copied."""
    base, numbers = _numbers(spark, target)
    if base is None and not numbers:
        return None
    newest = f"log/batch_id={numbers[-1]}" if numbers else f"log_base/upto={base}"
    return spark.read.schema(LOG).parquet(f"{target.root}/{newest}").agg(F.max("mark")).first()[0]


def _floor_part(target: Target, floor: dt.date) -> dt.date:
    found = {"day": floor, "month": floor.replace(day=1), "year": floor.replace(month=1, day=1)}
    return found[target.grain]


def folders(spark: SparkSession, target: Target, floor: dt.date | None = None, before: int | None = None) -> list[Folder]:
    """The folders that hold dates from ``floor`` on (None: all), as the log names them: metadata like a file listing."""
    records = _records(spark, target, before)
    if records is None:
        return []
    records = records.filter(F.col("folder").isNotNull())
    if floor is not None:
        records = records.filter(F.col("part") >= F.lit(_floor_part(target, floor)))
    return [Folder(row["part"], row["folder"]) for row in records.select("part", "folder").collect()]


def _read(spark: SparkSession, target: Target, found: Sequence[Folder]) -> DataFrame:
    schema = StructType(list(target.schema)).add("part", "date").add("folder", "string")
    paths = [folder.path(target) for folder in found]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{target.root}/data").parquet(*paths)


def copied(spark: SparkSession, target: Target, floor: dt.date | None = None, before: int | None = None) -> DataFrame:
    """The copy's rows, or those from a date on: then only the folders of such dates are opened."""
    rows = _read(spark, target, folders(spark, target, floor, before))
    if floor is not None:
        rows = rows.filter((F.col("part") >= F.lit(_floor_part(target, floor))) & (F.to_date(target.column) >= F.lit(floor)))
    return rows.select(*target.schema.fieldNames())


def _write(rows: DataFrame, target: Target, folder: str) -> None:
    """Rows into their date folders. A date that holds many rows is dealt to several tasks."""
    dealt = rows.select(*target.schema.fieldNames(), target.part().alias("part"), F.lit(folder).alias("folder")).hint("rebalance", F.col("part"))
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "folder")
    writer.parquet(f"{target.root}/data")


def _commit(rows: DataFrame, target: Target, number: int, held: dt.date | None) -> None:
    """The poll's record, written last. ``held`` is the mark before."""
    spark = rows.sparkSession
    touched = rows.groupBy(target.part().alias("part")).agg(F.count("*").alias("rows"), F.max(F.to_date(target.column)).alias("mark")).collect()
    newest = max((row["mark"] for row in touched if row["mark"] is not None), default=held)
    newest = newest if held is None else max(newest, held)
    log = [(row["part"], _name(number), row["rows"], newest) for row in touched] or [(None, None, 0, newest)]
    spark.createDataFrame(log, LOG).coalesce(1).write.mode("overwrite").parquet(f"{target.root}/log/batch_id={number}")


def _name(number: int) -> str:
    return f"poll-{number}"


def begin(rows: DataFrame, target: Target) -> None:
    """The first content, as a full copy leaves it. Rows without a date have a folder of their own."""
    _write(rows, target, _name(FIRST))
    _commit(rows, target, FIRST, None)


def poll(target: Target, empty_floor: Column | None = None, fold_every: int | None = 50) -> Callable[[DataFrame, int], None]:
    """Batch function of the polling sync: rows since the mark whose key the copy lacks.

    Source rows older than the mark, changes to copied rows and rows without a date are not seen; that is what
    this kind of sync does. ``empty_floor`` replaces the mark of an empty copy; the default is one hour before
    now. After every ``fold_every`` polls the folders of each date are folded into one.
    """
    if empty_floor is None:
        empty_floor = F.to_date(F.current_timestamp() - F.expr("interval 1 hour"))

    def work(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, batch_id + 1 + FIRST
        base, numbers = _numbers(spark, target)
        if number in numbers or (base is not None and number <= base):
            return
        held = mark(spark, target)
        floor = held or spark.range(1).select(empty_floor.cast("date")).first()[0]
        rows = new_rows(batch, target, floor, number).persist()  # written, and counted for the log
        try:
            _write(rows, target, _name(number))
            _commit(rows, target, number, held)
        finally:
            rows.unpersist()
        if fold_every and number % fold_every == 0:
            fold(spark, target, number)

    return work


def new_rows(batch: DataFrame, target: Target, floor: dt.date, before: int | None = None) -> DataFrame:
    """One row per key of those from the floor on that the copy lacks."""
    recent = batch.filter(F.to_date(target.column) >= F.lit(floor)).select(*target.schema.fieldNames())
    return one_per_key(missing_rows(recent, copied(batch.sparkSession, target, floor, before), target.keys), target.keys)


def fold(spark: SparkSession, target: Target, upto: int) -> None:
    """Folds each date's folders into one and the log into a new base.

    Only dates that several folders hold are rewritten: those polls touched since they were folded last. The folders
    that were folded are removed by the next fold, so that readers that have begun on them can end.
    """
    base, numbers = _numbers(spark, target)
    if base is not None and base >= upto:
        return
    found = folders(spark, target, before=upto + 1)
    by_part: dict[dt.date | None, list[Folder]] = {}
    for folder in found:
        by_part.setdefault(folder.part, []).append(folder)
    several = [folder for own in by_part.values() if len(own) > 1 for folder in own]
    name = f"upto-{upto}"
    if several:
        _write(_read(spark, target, several), target, name)
    newest = mark(spark, target)
    kept = _records(spark, target, before=upto + 1)
    sums = kept.filter(F.col("folder").isNotNull()).groupBy("part").agg(
        F.when(F.count("*") > 1, F.lit(name)).otherwise(F.any_value("folder")).alias("folder"), F.sum("rows").alias("rows")
    )
    log = sums.select("part", "folder", "rows", F.lit(newest).cast("date").alias("mark"))
    if not found:
        log = spark.createDataFrame([(None, None, 0, newest)], LOG)
    log.coalesce(1).write.mode("overwrite").parquet(f"{target.root}/log_base/upto={upto}")
    gone = spark.createDataFrame([(folder.part, folder.name, 0, newest) for folder in several], LOG)
    gone.coalesce(1).write.mode("overwrite").parquet(f"{target.root}/folded/upto={upto}")
    for number in finished_numbers(spark, f"{target.root}/folded/upto="):
        if number < upto:
            past = f"{target.root}/folded/upto={number}"
            for row in spark.read.schema(LOG).parquet(past).collect():
                remove_folder(spark, Folder(row["part"], row["folder"]).path(target))
            remove_folder(spark, past)
    for number in finished_numbers(spark, f"{target.root}/log/batch_id="):
        if base is not None and number <= base:
            remove_folder(spark, f"{target.root}/log/batch_id={number}")
    for number in finished_numbers(spark, f"{target.root}/log_base/upto="):
        if base is not None and number < base:
            remove_folder(spark, f"{target.root}/log_base/upto={number}")
