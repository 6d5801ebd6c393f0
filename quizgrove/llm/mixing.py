"""Mixing sources to target weights (operator 9), with DataFrame functions only.

Efraimidis-Spirakis sampling: each document draws the key -ln(u) / w, u from a digest of its id and the seed, w
its quality weight. A source gives as many whole epochs as its target holds; the rest of the target goes to the
documents with the least keys, in order, until their sizes add up to it.

No source is ordered as a whole: keys fall into buckets of some thousand documents, sizes are added up by bucket
before they are shuffled, and only the bucket in which a source's budget ends is sorted. Where weights are so
uneven that this bucket is large, it is cut by its own range of keys until it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizgrove.llm.common import counted
from quizgrove.session import saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Documents in a bucket, on average.
BUCKET_ROWS = 4096
#: A bucket in which a budget ends is cut further while it holds more documents than this.
END_ROWS = 64 * BUCKET_ROWS
WORD = r"[^\x20\x09-\x0D]+"


def uniform(doc_id: Column, seed: str) -> Column:
    """A number above 0 and below 1 from 52 bits of a digest of the id; the same in each run."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def sums_before(rows: DataFrame, order: Sequence[Column], **values: Column) -> DataFrame:
    """``rows`` with the sum of each of ``values`` over the rows before each, in ``order``.

    No task sees all rows: they are dealt out by ranges of the order, and only the sums of ranges are added up in one.
    """
    rows = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    rows = saved(rows, "source-ranges")
    sums = rows.groupBy("range").agg(*(F.sum(value).alias(name) for name, value in values.items()))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_ranges") for name in values))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(counted(sums), "range")
    own = {name: F.col(f"{name}_ranges") + F.coalesce(F.sum(value).over(within), F.lit(0)) for name, value in values.items()}
    return rows.withColumns(own).drop("range", *(f"{name}_ranges" for name in values))


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, docs) with each source's weight and target.

    Weights go round by code point order, null last. The targets share the sum of all sizes by weight; none goes
    beyond ``most`` times its source, and what is above is shared by the others: the target is
    min(most * size, level * weight), and the level follows from the sources in order of most * size / weight,
    the order in which they fill up. Sources are ordered by ranges, so that their number has no bound.
    """
    by_name = F.col("source").asc_nulls_last()
    rows = sums_before(sources, [by_name], place=F.lit(1))
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", cycle.cast("long")).withColumn("most", F.lit(most) * F.col("source_size")).drop("place")
    rows = rows.withColumn("filling", F.col("most") / F.col("weight"))
    order = [F.col("filling"), by_name]
    rows = saved(sums_before(rows, order, full=F.col("most"), used=F.col("weight")), "source-levels")
    everything = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weights"))
    # the level if just the sources before this one are full; it holds for the first that doesn't fill up
    levels = rows.crossJoin(F.broadcast(everything))
    levels = levels.withColumn("level", (F.col("size") - F.col("full")) / (F.col("weights") - F.col("used")))
    holds = levels.filter(F.col("level") * F.col("weight") <= F.col("most"))
    # null comes last among the sources, but first in a struct
    first = holds.agg(F.min(F.struct("filling", F.col("source").isNull(), "source", "level"))["level"].alias("level"))
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("target", target)
    return rows.select("source", "source_size", "docs", "weight", "target")


def drawn(docs: DataFrame, seed: str, *carried: str) -> DataFrame:
    """source, doc_id, size, key, tie (a digest of the text) and the columns ``carried`` in a struct ``doc``.

    The size is the number of words (null text: 0). The quality weight is higher the nearer a document's mean
    word length is to five letters, from 0 to 1.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    mean = F.coalesce(F.char_length("text"), F.lit(0)) / F.greatest(F.col("size"), F.lit(1)) - 1
    weight = 1 / (1 + F.abs(mean - 5) / 5)
    rows = docs.select("source", "doc_id", "text", F.struct(*carried).alias("doc")).withColumn("size", size)
    key = -F.ln(uniform(F.col("doc_id"), seed)) / weight
    tie = F.md5(F.coalesce("text", F.lit("")))
    return rows.select("source", "doc_id", "size", key.alias("key"), tie.alias("tie"), "doc")


def bucket_of(key: Column, buckets: Column) -> Column:
    """The bucket of a key, ascending with it; even if all weights are 1."""
    return F.least(buckets - 1, F.floor(buckets * (1 - F.exp(-key))))


def by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined with a table of one row a source, null included."""
    table = table.withColumnRenamed("source", "of")
    return rows.join(counted(table), F.col("source").eqNullSafe(F.col("of"))).drop("of")


def ending(sums: DataFrame, rest: DataFrame, budget: str) -> DataFrame:
    """of (the source) and end: what the part in which its budget ends leaves of it, its least and greatest key and rows.

    ``sums``: source, part (ascending with the keys), size, low, high, rows. ``rest`` has the budget of each source.
    """
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = by_source(sums.withColumn("upto", F.sum("size").over(upto)), rest.select("source", budget))
    left = (F.col(budget) - F.col("upto") + F.col("size")).alias("left")
    ends = sums.filter(F.col("upto") > F.col(budget)).groupBy(F.col("source").alias("of"))
    return ends.agg(F.min(F.struct("part", left, "low", "high", "rows")).alias("end"))


def narrowed(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with each large ending bucket cut into even ranges of its keys, and the one in which the budget ends kept."""
    wide = plan.filter((F.col("rows") > END_ROWS) & (F.col("low") < F.col("high")))
    wide = wide.select("source", "left", "low", "high", F.ceil(F.col("rows") / BUCKET_ROWS).alias("parts"))
    inside = by_source(slim.select("source", "size", "key"), wide.drop("left")).filter("key BETWEEN low AND high")
    part = F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("parts"))
    ends = ending(part_sums(inside, F.least(F.col("parts") - 1, part)), wide, "left")
    both = plan.join(ends, F.col("source").eqNullSafe(F.col("of")), "left")
    newer = [F.coalesce(f"end.{name}", name).alias(name) for name in ("left", "low", "high", "rows")]
    return both.select("source", "source_size", "target", "epochs", *newer)


def part_sums(rows: DataFrame, part: Column) -> DataFrame:
    sums = (F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"))
    return rows.groupBy("source", part.alias("part")).agg(*sums)


def budgets(slim: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """One row a source: its size and target, the whole epochs, the keys (low to high) of the bucket in which the rest
    of the target ends, its rows, and what the documents before it leave of the rest."""
    targets = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(targets, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long"))
    targets = targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = saved(targets.withColumn("buckets", F.ceil(F.col("docs") / BUCKET_ROWS).cast("long")), "mix-targets")
    sums = part_sums(by_source(slim, targets.select("source", "buckets")), bucket_of(F.col("key"), F.col("buckets")))
    ends = ending(sums, targets, "budget")
    plan = targets.join(ends, F.col("source").eqNullSafe(F.col("of")), "left")
    plan = saved(plan.select("source", "source_size", "target", "epochs", "end.left", "end.low", "end.high", "end.rows"), "mix-plan")
    while not plan.filter((F.col("rows") > END_ROWS) & (F.col("low") < F.col("high"))).isEmpty():
        plan = saved(narrowed(slim, plan), "mix-plan")
    return plan


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``drawn`` with their source's source_size and target, and copies: the times each is taken."""
    rows = by_source(rows, plan.drop("rows"))
    here = F.coalesce(F.col("key").between(F.col("low"), F.col("high")), F.lit(False)) & (F.col("size") > 0)
    earlier = F.coalesce(F.col("key") < F.col("low"), F.lit(False)) & (F.col("size") > 0)
    certain = rows.filter(~here).withColumn("more", earlier.cast("long"))
    in_order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "tie")
    whole = Window.partitionBy("source")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.filter(here).withColumn("upto", F.sum("size").over(upto)).withColumn("place", F.row_number().over(in_order))
    fits = F.col("upto") <= F.col("left")
    last = last.withColumn("rest", F.col("left") - F.coalesce(F.max(F.when(fits, F.col("upto"))).over(whole), F.lit(0)))
    off = F.abs(F.col("size") - F.col("rest"))
    nearest = F.min(F.when(~fits & (off < F.col("rest")), F.struct(off.alias("off"), "place"))).over(whole)
    one_more = F.coalesce(F.col("place") == nearest["place"], F.lit(False))
    last = last.withColumn("more", (fits | one_more).cast("long")).drop("upto", "place", "rest")
    both = certain.unionByName(last)
    return both.withColumn("copies", F.col("epochs") + F.col("more"))


def mix_table(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of each row.

    A source's taken words come to its target but for less than a document: after the whole epochs, documents
    are taken in order of their keys while the sum stays within the budget; then one more of the same bucket, the
    one whose size is nearest to what is left, if that brings the sum nearer. Rows with equal keys (a shared or
    null id) follow each other by id and text; equal rows are taken one by one. Rows without words (null and empty
    texts) take none. Every row is returned; other columns of ``docs`` are not read; an empty table gives no rows.
    """
    slim = saved(drawn(docs, seed, "doc_id"), "mix-sizes")
    rows = taken(slim, budgets(slim, weights, most))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as it is taken; see ``mix_table``."""
    slim = saved(drawn(docs, seed, "doc_id"), "mix-sizes")
    rows = taken(drawn(docs, seed, *docs.columns), budgets(slim, weights, most)).filter("copies > 0 AND size > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
