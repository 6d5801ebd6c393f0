"""Question files: delimited exports, legacy files, enriched copies, model tables, reports, page fragments."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quizgrove.functions.text import looks_like_options

# Column order of an export without a header.
EXPORT_COLUMNS = (
    "question_id", "type_id", "region_id", "section_id", "grade_id", "subject_id", "term_id", "version_id",
    "difficulty_id", "tag_id", "content", "options", "answer", "answer_list", "analysis", "audio_url",
    "create_by", "created_date", "update_by", "updated_date", "source_id", "org_path", "is_delete", "save_type",
    "school_id", "visible", "question_archive",
)
# The text columns a loaded table always has.
KEY_COLUMNS = ("question_id", "content", "options", "answer", "analysis")
# Known positions of a legacy file.
LEGACY_POSITIONS = {
    0: "question_id", 1: "subject_id", 3: "type_id", 5: "grade_id", 8: "difficulty_id",
    10: "content", 12: "answer", 13: "answer_list", 14: "analysis",
}
SNIFF_CHARACTERS = 2048
ENRICHED = "_enriched"


def separator_counts(spark: SparkSession, path: str) -> DataFrame:
    """Tabs and commas among the first characters of a file, and the separator they speak for.

    Tab if there are tabs and not fewer than commas, else comma.
    """
    # the first lines: further partitions are read only while there are too few
    lines = spark.read.text(path).select(F.substring("value", 1, SNIFF_CHARACTERS).alias("line")).head(SNIFF_CHARACTERS)
    first = "\n".join(line.line for line in lines)[:SNIFF_CHARACTERS]
    head = spark.range(1).select(F.lit(first).alias("head"))
    counts = [
        (F.length("head") - F.length(F.replace(F.col("head"), F.lit(mark), F.lit("")))).cast("long").alias(name)
        for name, mark in (("tabs", "\t"), ("commas", ","))
    ]
    tab = F.col("tabs") >= F.greatest(F.col("commas"), F.lit(1))
    return head.select(*counts).withColumn("separator", F.when(tab, "\t").otherwise(","))


def detect_separator(spark: SparkSession, path: str) -> str:
    return separator_counts(spark, path).first().separator


def _cells(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Each line that isn't empty with its cells; no quoting, so a separator always separates."""
    lines = spark.read.text(path).filter(F.length("value") > 0)
    return lines.select("value", F.split("value", _literal(separator), -1).alias("cells"))


def _literal(text: str) -> str:
    """``text`` as a pattern that fits only itself."""
    return "".join(f"\\{mark}" if mark in "\\.[]{}()*+?^$|" else mark for mark in text)


def _rows(cells: DataFrame, names: list[str], header: str | None) -> DataFrame:
    """All columns as text: short rows end in NULLs, empty cells are NULL, rows with too many cells are left out.

    Which rows there are depends on the lines alone, not on the columns that are read later.
    """
    kept = cells.filter(F.size("cells") <= len(names))
    if header is not None:
        kept = kept.filter(F.col("value") != header)
    return kept.select(*[F.nullif(F.get("cells", F.lit(at)), F.lit("")).alias(name) for at, name in enumerate(names)])


def _layout(spark: SparkSession, path: str, separator: str) -> tuple[list[str], str | None]:
    """Column names and, if the file names them itself, the line that does."""
    line = spark.read.text(path).head()
    first = [""] if line is None else line.value.split(separator)
    if "question_id" in first:
        return first, line.value
    return list(EXPORT_COLUMNS[: len(first)]), None


def load_export(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A question export with or without a header (S3). Texts rich in commas need a stated separator.

    Lines with more cells than columns are left out; ``rejected_lines`` has them.
    """
    separator = separator or detect_separator(spark, path)
    names, header = _layout(spark, path, separator)
    rows = _rows(_cells(spark, path, separator), names, header)
    for name in KEY_COLUMNS:
        if name not in names:
            rows = rows.withColumn(name, F.lit(""))
    return rows


def rejected_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """The lines that a loader leaves out for having too many cells, and how many they have."""
    separator = separator or detect_separator(spark, path)
    names, _ = _layout(spark, path, separator)
    cells = _cells(spark, path, separator).filter(F.size("cells") > len(names))
    return cells.select(F.col("value").alias("line"), F.size("cells").alias("n_cells"))


def load_legacy(
    spark: SparkSession, path: str, separator: str | None = None, first_row: bool = False
) -> DataFrame:
    """A header-less file with a few known positions and an options column to find."""
    separator = separator or detect_separator(spark, path)
    line = spark.read.text(path).head()
    width = 1 if line is None else len(line.value.split(separator))
    names = [LEGACY_POSITIONS.get(place, f"column_{place}") for place in range(width)]
    return name_options(_rows(_cells(spark, path, separator), names, None), first_row)


def name_options(rows: DataFrame, first_row: bool = False) -> DataFrame:
    """Renames the rightmost column whose values look like answer options.

    Most of a column's filled values must match, over all rows; ``first_row`` looks at one row only.
    """
    texts = [name for name in rows.columns if rows.schema[name].dataType == StringType()]
    if not texts:
        return rows
    voters = rows.limit(1) if first_row else rows
    votes = voters.agg(
        *[F.count_if(looks_like_options(F.col(name))).alias(f"{name}_hits") for name in texts],
        *[F.count_if(F.length(F.trim(name)) > 0).alias(f"{name}_filled") for name in texts],
    ).first()
    for name in reversed(texts):
        if votes[f"{name}_hits"] * 2 > votes[f"{name}_filled"]:
            kept = rows.drop("options") if name != "options" and "options" in rows.columns else rows
            return kept.withColumnRenamed(name, "options")
    return rows


def enriched_path(path: str) -> str:
    """``name.csv`` becomes ``name_enriched.csv``, also when it was enriched before."""
    stem, extension = os.path.splitext(path)
    return f"{stem.removesuffix(ENRICHED)}{ENRICHED}{extension}"


def save_enriched(rows: DataFrame, path: str) -> str:
    """Writes a tab-separated copy next to the source file (S16). Line breaks and tabs become blanks."""
    target = enriched_path(path)
    flat = [F.regexp_replace(F.col(name).cast("string"), r"[\t\r\n]+", " ").alias(name) for name in rows.columns]
    rows.select(*flat).write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="").csv(target)
    return target


def save_model(items: DataFrame, path: str) -> None:
    """Items with their embeddings as one table (S17). Counts and shapes are derived, not stored."""
    items.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_report(rows: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


FRAGMENT_SCHEMA = "big_questions array<struct<qid:int,bbox:array<int>>>"


def page_fragments(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Fragments of nested JSON documents, one per file or one per line: qid and box corners."""
    documents = spark.read.schema(FRAGMENT_SCHEMA).json(path, multiLine=multi_line)
    return fragments(documents)


def fragments(documents: DataFrame) -> DataFrame:
    corners = {"x1": 0, "y1": 1, "x2": 2, "y2": 3}
    rows = documents.select(F.explode("big_questions").alias("q"))
    return rows.select("q.qid", *[F.get("q.bbox", F.lit(at)).alias(name) for name, at in corners.items()])


def envelopes(boxes: DataFrame) -> DataFrame:
    """Per question: number of fragments, enclosing box and total area."""
    return boxes.groupBy("qid").agg(
        F.count("*").alias("n_fragments"),
        F.min("x1").alias("x1"),
        F.min("y1").alias("y1"),
        F.max("x2").alias("x2"),
        F.max("y2").alias("y2"),
        F.sum((F.col("x2") - F.col("x1")).cast("long") * (F.col("y2") - F.col("y1"))).alias("area"),
    )


def first_rows(rows: DataFrame, order: str, count: int = 50) -> DataFrame:
    """The first rows in a stated order."""
    return rows.orderBy(order).limit(count)
