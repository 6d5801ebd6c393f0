"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Rows of a few narrow columns that one task of ``saved`` writes, where the caller knows how many there can be.
ROWS_A_TASK = 1 << 16

_own_folder: str | None = None


def build_session(app: str = "quizgrove", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect. Cluster settings given in ``conf`` win."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
        settings |= {
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
        }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a session that names none (tests, one machine) gets a folder of its own.
    """
    global _own_folder
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="quizgrove-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _own_folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path not used before, below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def finished_numbers(spark: SparkSession, prefix: str) -> list[int]:
    """The numbers n of the finished folders ``{prefix}{n}``, from the shared file system."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{prefix}*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found or [])


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For results that several branches use: they are computed once, a lost executor does not bring the
    work back, and the next plan starts from a table of known size.

    ``rows`` says how many narrow rows ``df`` can have. Where there are more partitions than these rows need, fewer tasks
    write: a small table isn't a file for each shuffle partition. Only for frames whose last shuffle deals out rows in proportion.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_TASK)))
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
