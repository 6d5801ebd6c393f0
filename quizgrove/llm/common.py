"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is sent to every executor. The count is taken first; a larger side is shuffled.
BROADCAST_ROWS = 100_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to hold at most ``limit`` rows, else to be shuffled.

    Only for frames of a few narrow columns that are cheap to count (saved tables, parameters).
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of an equi-join that shuffles both sides, whatever size Spark takes either for.

    Spark sizes a stored table by its compressed files and an exploded one by the rows before, so it may send to every
    executor, through the driver, what holds many times the bytes.
    """
    return df.hint("merge")


def sent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to hold ``rows`` narrow rows at most, as a side of a join: sent to every executor if they are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else shuffled(df)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: str = "2m"):
    """Jobs started inside send texts to Python workers in small batches, so that neither side holds many of them."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def new_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever its own columns are called."""
    taken = {column.lower() for column in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_key(text: Column) -> Column:
    """64 bits of a text. With the id beside it, it tells apart rows that share an id."""
    return F.xxhash64(text)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and no other letter changed."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))
