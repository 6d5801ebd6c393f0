"""Boilerplate lines by the number of sites they stand on (operator 5), DataFrame functions only.

Each line's hash gets a HyperLogLog sketch of the sites it was seen on; sketches merge by aggregation. A line whose
estimate is clearly above the threshold is boilerplate, one clearly below it is not, and the sites of
those near it are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizgrove.llm.common import text_key
from quizgrove.session import saved

#: Sites from which on a line is boilerplate.
MIN_SITES = 5
#: Sketches of 2**LG_BUCKETS buckets have a standard error of 1.04 / sqrt(buckets).
LG_BUCKETS = 12
#: Standard errors around the threshold within which sites are counted.
NEAR_ERRORS = 6.0


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, site: str) -> DataFrame:
    """doc_id, text_key, site, number (from 0) and the 128-bit hash (two longs, null for blank lines) of each line."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col(site).cast("string").alias("site"), F.posexplode(lines(F.col("text"))).alias("number", "line"))
    bare = F.btrim(F.col("line"), F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumn("bare", bare)
    there = F.col("bare") != ""
    return rows.select(
        "doc_id",
        "text_key",
        "site",
        "number",
        F.when(there, F.xxhash64("bare")).alias("hash"),
        F.when(there, F.xxhash64(F.lit(1), F.col("bare"))).alias("hash2"),
    )


def spread_lines(rows: DataFrame, min_sites: int) -> DataFrame:
    """hash and hash2 of the lines on at least ``min_sites`` different sites (null is no site)."""
    seen = rows.filter("hash IS NOT NULL AND site IS NOT NULL")
    sketches = seen.groupBy("hash", "hash2").agg(F.hll_sketch_agg(F.col("site"), F.lit(LG_BUCKETS)).alias("sketch"))
    off = max(1.0, NEAR_ERRORS * 1.04 / 2 ** (LG_BUCKETS / 2) * min_sites)
    estimate = F.hll_sketch_estimate("sketch")
    judged = saved(sketches.select("hash", "hash2", estimate.alias("sites")).filter(F.col("sites") >= min_sites - off), "spread-lines")
    clear = judged.filter(F.col("sites") > min_sites + off).select("hash", "hash2")
    near = judged.filter(F.col("sites") <= min_sites + off).select("hash", "hash2")
    exact = seen.select("hash", "hash2", "site").join(near, ["hash", "hash2"]).groupBy("hash", "hash2")
    exact = exact.agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return clear.unionByName(exact.select("hash", "hash2"))


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, text (without boilerplate lines), n_lines and n_removed of each row of ``docs``.

    Lines are compared without white space at their ends; blank lines are never removed. A null text has no lines and
    stays null; equal rows lose the same lines; other columns are not read; an empty table gives no rows. A line that
    very many rows share is reduced to a sketch in each task before anything is shuffled, and joined back as
    Spark splits skewed joins.
    """
    rows = saved(line_rows(docs, site), "lines")
    common = saved(spread_lines(rows, min_sites), "boilerplate")
    flagged = rows.filter("hash IS NOT NULL").join(common, ["hash", "hash2"])
    numbers = flagged.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"))
    numbers = numbers.agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    here = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    whole = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").join(numbers, here, "left")
    whole = whole.select("doc_id", "text", lines(F.col("text")).alias("lines"), "numbers")
    return whole.select(
        "doc_id",
        F.when(F.col("numbers").isNull(), F.col("text")).otherwise(kept_lines(F.col("lines"), F.col("numbers"))).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("n_removed"),
    )


def kept_lines(all_lines: Column, numbers: Column) -> Column:
    """The lines between the removed numbers, joined again: one slice of the lines for each gap."""
    ends = F.concat(numbers, F.array(F.size(all_lines)))
    begins = F.concat(F.array(F.lit(0)), F.transform(numbers, lambda n: n + 1))
    gaps = F.arrays_zip(begins.alias("begin"), ends.alias("end"))
    return F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(all_lines, g["begin"] + 1, g["end"] - g["begin"]))), "\n")


def line_table(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and text_sha256 (of the text that is left) of each row."""
    rows = without_boilerplate(docs, site, min_sites)
    return rows.select(
        "doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )
