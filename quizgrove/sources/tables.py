"""Source tables over SQL and JDBC, their types, and target tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType,
    StringType, StructField, StructType, TimestampNTZType,
)

from quizgrove.operators.replicate import missing_rows, one_per_key
from quizgrove.session import finished_numbers, remove_folder

# Source column types and the type each becomes.
_TYPES: dict[str, DataType] = {
    "tinyint": ByteType(),
    "smallint": ShortType(),
    "mediumint": IntegerType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "float": FloatType(),
    "double": DoubleType(),
    "varchar": StringType(),
    "char": StringType(),
    "text": StringType(),
    "longtext": StringType(),
    "date": DateType(),
    "datetime": TimestampNTZType(),
    "timestamp": TimestampNTZType(),
    "json": StringType(),
    "bool": BooleanType(),
}
_WIDER: dict[str, DataType] = {
    "tinyint": ShortType(),
    "smallint": IntegerType(),
    "mediumint": IntegerType(),
    "int": LongType(),
    "bigint": DecimalType(20, 0),
}


def scan(spark: SparkSession, sql: str, args: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """A parameterised query; errors reach the caller."""
    return spark.sql(sql, args=dict(args or {}), **tables)


def jdbc_options(
    url: str, table: str, key: str, lower: object, upper: object, partitions: int, fetch_size: int = 1000
) -> dict[str, str]:
    """Options of a partitioned table read: each task reads one key range."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def read_jdbc(spark: SparkSession, options: Mapping[str, str], **login: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options, **login).load()


def describe(df: DataFrame) -> DataFrame:
    """Column names, types and the row count of a table."""
    names = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString())
                               .alias("type")) for i, f in enumerate(df.schema.fields)])
    return df.agg(F.count("*").alias("n_rows")).select(F.inline(names), "n_rows")


def spark_type(source_type: str) -> DataType:
    """The type for a source column type such as ``decimal(5,4)`` or ``int(11) unsigned``."""
    text = source_type.strip().lower()
    name = re.split(r"[\s(]", text, maxsplit=1)[0]
    numbers = [int(n) for n in re.findall(r"\d+", text)]
    if name in ("decimal", "numeric"):
        return DecimalType(*(numbers[:2] if len(numbers) > 1 else [*numbers[:1], 0] if numbers else [10, 0]))
    if "unsigned" in text and name in _WIDER:
        return _WIDER[name]
    return _TYPES.get(name, StringType())


def spark_schema(columns: Sequence[tuple[str, str, bool]]) -> StructType:
    """Schema for (name, source type, nullable) rows."""
    return StructType([StructField(name, spark_type(kind), nullable) for name, kind, nullable in columns])


def key_columns(columns: Sequence[tuple[str, str]]) -> list[str]:
    """Key of a target table: primary and unique columns, else the first one. Rows are (name, key kind)."""
    keys = [name for name, kind in columns if kind in ("PRI", "UNI")]
    return keys or [columns[0][0]]


def create_table(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """A table bucketed by its key, so that joins and upserts on the key need no shuffle.

    ``buckets`` follows the table's size: rows are dealt by bucket first, so that each is one file, written by one task.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def insert_missing(rows: DataFrame, name: str, keys: Sequence[str], buckets: int) -> Observation:
    """Appends to a bucketed table, one per key, the rows whose key it lacks (C3); the observation holds ``n_rows``.

    If ``rows`` is a table bucketed alike, neither the search for known keys nor the choice of one row a key shuffles.
    """
    added, target = Observation("added"), rows.sparkSession.table(name)
    new = one_per_key(missing_rows(rows, target, keys), keys).select(*target.columns)
    new = new.repartition(buckets, *keys).observe(added, F.count("*").alias("n_rows"))
    new.write.bucketBy(buckets, *keys).sortBy(*keys).mode("append").saveAsTable(name)
    return added


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema, cast to its types."""
    return df.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema.fields])


def write_full(df: DataFrame, path: str) -> Observation:
    """Replaces a copy; the observation holds the number of rows written.

    A copy is a new version below ``path``; ``read_full`` takes the newest finished one, so a failed job leaves the last
    copy as it was. The version before stays for readers that have begun on it; older ones go.
    """
    spark, rows = df.sparkSession, Observation("copied")
    versions = finished_numbers(spark, f"{path}/version=")
    number = versions[-1] + 1 if versions else 0
    df.observe(rows, F.count("*").alias("n_rows")).write.mode("overwrite").parquet(f"{path}/version={number}")
    for old in versions[:-1]:
        remove_folder(spark, f"{path}/version={old}")
    return rows


def read_full(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished copy that ``write_full`` left below ``path``."""
    versions = finished_numbers(spark, f"{path}/version=")
    if not versions:
        raise FileNotFoundError(f"no finished copy below {path}")
    return spark.read.parquet(f"{path}/version={versions[-1]}")


def sync_table(
    source: DataFrame, columns: Sequence[tuple[str, str, bool, str]], name: str, buckets: int, path: str | None = None
) -> tuple[DataFrame, Observation]:
    """A full copy of a source table: its schema, the target table by its key, the rows and their number.

    ``columns``: name, source type, nullable and key kind of each. Returns the target and the observed ``n_rows``.
    """
    schema = spark_schema([column[:3] for column in columns])
    keys = key_columns([(column[0], column[3]) for column in columns])
    copied = Observation("copied")
    create_table(typed(source, schema).observe(copied, F.count("*").alias("n_rows")), name, keys, buckets, path)
    return source.sparkSession.table(name), copied


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
