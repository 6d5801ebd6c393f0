"""Batch replication and reconciliation of a source and a target table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizgrove.functions.values import days_behind, latency_ms
from quizgrove.operators.ranking import percentiles
from quizgrove.session import saved

# Fixed value: row gap below which the copy counts as healthy.
HEALTHY_GAP = 1000


def high_water_mark(target: DataFrame, column: str) -> DataFrame:
    """The newest date of the target."""
    return target.agg(F.max(column).alias("mark"))


def missing_rows(rows: DataFrame, target: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows whose key the target lacks."""
    keys = list(keys)
    held = target.select(*keys)
    if not null_safe:
        return rows.join(held, keys, "left_anti")
    held = held.select(*[F.col(key).alias(f"held_{key}") for key in keys])
    same = [F.col(key).eqNullSafe(F.col(f"held_{key}")) for key in keys]
    return rows.join(held, same, "left_anti")


def incremental_rows(
    source: DataFrame, target: DataFrame, column: str, keys: Sequence[str], empty_floor: Column | None = None
) -> DataFrame:
    """New rows since the target's newest date (C2): source rows on or after it without a target row.

    Older source rows and changes to copied rows are not seen; that is what this kind of sync does.
    ``empty_floor`` replaces the mark of an empty target; the default is one hour before now.
    """
    if empty_floor is None:
        empty_floor = F.to_date(F.current_timestamp() - F.expr("interval 1 hour"))
    mark = high_water_mark(target, column).select("mark").scalar()
    floor = F.coalesce(mark, empty_floor)
    recent = source.filter(F.col(column) >= floor)
    return missing_rows(recent, target.filter(F.col(column) >= floor), keys)


def insert_skip(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target after inserting rows, one per key, skipping known keys."""
    return target.unionByName(one_per_key(missing_rows(rows, target, keys), keys))


def one_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows with a key, the least by their other columns in order, so that each run keeps the same."""
    others = [name for name in rows.columns if name not in keys]
    if not others:
        return rows.distinct()
    kept = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("kept_row"))
    return kept.select(*keys, "kept_row.*").select(*rows.columns)


def reconcile(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """One row: counts, newest dates, equality and days behind."""
    left = source.agg(F.count("*").alias("source_count"), F.max(column).alias("source_latest"))
    right = target.agg(F.count("*").alias("target_count"), F.max(column).alias("target_latest"))
    row = left.withColumn("target_count", right.select("target_count").scalar()).withColumn(
        "target_latest", right.select("target_latest").scalar()
    )
    return row.select(
        "*",
        (F.col("source_count") == F.col("target_count")).alias("same_count"),
        F.col("source_latest").eqNullSafe(F.col("target_latest")).alias("same_latest"),
        days_behind(F.col("source_latest"), F.col("target_latest")).alias("days_behind"),
    )


def gap(source: DataFrame, target: DataFrame, healthy: int = HEALTHY_GAP, signed: bool = False) -> DataFrame:
    """Row difference and its verdict (C12, A9). ``signed`` also accepts any surplus in the target."""
    row = source.agg(F.count("*").alias("source_count")).withColumn(
        "target_count", target.agg(F.count("*")).scalar()
    )
    difference = F.col("source_count") - F.col("target_count")
    judged = difference if signed else F.abs(difference)
    return row.withColumn("difference", difference).withColumn("healthy", judged < healthy)


def _changed(rows: DataFrame, name: str) -> Column:
    return ~F.col(f"s.{name}").eqNullSafe(F.col(f"t.{name}"))


#: Leaves of a digest tree have numbers of so many bits; the upper half of the bits are a leaf's branch.
LEAF_BITS = 16


def _leaf(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(key).cast("string") for key in keys]), F.lit(1 << LEAF_BITS)).cast("int")


def digest_tree(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """leaf, rows and two sums of 64-bit hashes of all rows whose keys fall into the leaf, whatever their order.

    Rows with equal texts of all columns have equal hashes, NULL apart from every text. Each task adds up its own rows first, so
    that what is shuffled are leaves.
    """
    texts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in columns] + [F.col(name).isNull() for name in columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *texts).cast("decimal(20,0)")).alias(f"sum_{seed}") for seed in (1, 2)]
    return rows.groupBy(_leaf(keys).alias("leaf")).agg(F.count("*").alias("n_rows"), *sums)


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    names = [name for name in left.columns if name != key]
    pairs = left.join(right.select(key, *[F.col(name).alias(f"other_{name}") for name in names]), key, "full")
    return pairs.filter(~reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"other_{name}")) for name in names])).select(key)


def differing_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """The leaves of two digest trees that differ: branches are compared first, and leaves only below those that differ."""
    half = LEAF_BITS // 2

    def branches(tree: DataFrame) -> DataFrame:
        sums = [F.sum(name).alias(name) for name in tree.columns if name != "leaf"]
        return tree.groupBy(F.shiftright("leaf", half).alias("branch")).agg(*sums)

    differing = F.broadcast(_joined(branches(left), branches(right), "branch"))  # at most 2**half rows
    below = [tree.withColumn("branch", F.shiftright("leaf", half)).join(differing, "branch", "left_semi").drop("branch") for tree in (left, right)]
    return _joined(*below, "leaf")


def unequal_parts(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides without the rows of leaves whose digests are equal. Rows with a NULL key stay, as they match nothing."""
    names = [name for name in source.columns if name in target.columns]
    trees = [saved(digest_tree(side, keys, names), "digest-tree") for side in (source, target)]
    leaves = F.broadcast(saved(differing_leaves(*trees), "differing-leaves"))  # at most 2**LEAF_BITS narrow rows
    null_key = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])

    def part(side: DataFrame) -> DataFrame:
        marked = side.withColumn("leaf", _leaf(keys)).join(leaves.withColumn("differs", F.lit(True)), "leaf", "left")
        return marked.filter(F.col("differs") | null_key).select(*side.columns)

    return part(source), part(target)


def _paired(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    left = source.withColumn("in_source", F.lit(True)).alias("s")
    right = target.withColumn("in_target", F.lit(True)).alias("t")
    return left.join(right, [F.col(f"s.{key}") == F.col(f"t.{key}") for key in keys], "full")


def verify(source: DataFrame, target: DataFrame, keys: Sequence[str], colocated: bool = False) -> DataFrame:
    """Over all keys: missing rows, extra rows, and differing values per column.

    Digests of key buckets are compared first, and only rows of buckets that differ meet. Rows that share a key are equal if
    both sides hold the same ones. ``colocated``: both are tables bucketed by the keys into equally many buckets; then
    they are joined bucket by bucket without a shuffle, and digests would only be a second scan.
    """
    if not colocated:
        source, target = unequal_parts(source, target, keys)
    names = [name for name in source.columns if name not in keys and name in target.columns]
    both = F.col("in_source").isNotNull() & F.col("in_target").isNotNull()
    pairs = _paired(source, target, keys)
    row = pairs.agg(
        F.count_if(F.col("in_target").isNull()).alias("missing"),
        F.count_if(F.col("in_source").isNull()).alias("extra"),
        *[F.count_if(both & _changed(pairs, name)).alias(f"changed_{name}") for name in names],
    )
    return row.unpivot([], row.columns, "check_name", "n_rows")


def changed_rows(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and column with a different value, as text (J15), from buckets whose digests differ."""
    source, target = unequal_parts(source, target, keys)
    names = [name for name in source.columns if name not in keys and name in target.columns]
    pairs = _paired(source, target, keys).filter(F.col("in_source").isNotNull() & F.col("in_target").isNotNull())
    cells = F.array(
        *[
            F.when(
                _changed(pairs, name),
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.col(f"s.{name}").cast("string").alias("source_value"),
                    F.col(f"t.{name}").cast("string").alias("target_value"),
                ),
            )
            for name in names
        ]
    )
    return pairs.select(*[F.col(f"s.{key}") for key in keys], F.inline(F.filter(cells, F.isnotnull)))


def newest(rows: DataFrame, order: Sequence[str], count: int = 100) -> DataFrame:
    """The newest rows in descending order of all given columns."""
    return rows.orderBy(*[F.col(name).desc() for name in order]).limit(count)


def since(rows: DataFrame, column: str, floor: object) -> DataFrame:
    """Rows on or after a date; the condition reaches the scan."""
    return rows.filter(F.col(column) >= F.lit(floor))


def risk_groups(warnings: DataFrame) -> DataFrame:
    """Count and mean rates per risk level (A5)."""
    return warnings.groupBy("risk_level").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("attendance_rate"), 9).alias("mean_attendance"),
        F.round(F.avg("submit_rate"), 9).alias("mean_submit"),
    )


def latest_dates(rows: DataFrame, column: str) -> DataFrame:
    """Row count and newest date (A4)."""
    return rows.agg(F.count("*").alias("n_rows"), F.max(column).alias("latest"))


def op_statistics(changes: DataFrame) -> DataFrame:
    """Rows and newest change per operation."""
    known = changes.filter(F.col("op").isNotNull())
    return known.groupBy("op").agg(F.count("*").alias("n_rows"), F.max("ts_ms").alias("latest_ts_ms"))


def latest_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts_ms", "kafka_offset")) -> DataFrame:
    """The last change of each key by event time, then offset.

    An aggregate that each task begins on its own rows; as it keeps whole rows, Spark sorts a task's rows by key for it.
    """
    rest = [name for name in changes.columns if name not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*keys, "last.*")


def live_rows(latest: DataFrame) -> DataFrame:
    """Without deleted keys."""
    return latest.filter(F.col("op") != "d")


def latency(changes: DataFrame, as_of: Column, last: int | None = 10) -> DataFrame:
    """Mean latency of the newest changes, in milliseconds (C13, A8); ``last=None`` takes them all."""
    rows = changes.filter(F.col("ts_ms").isNotNull())
    if last is not None:
        rows = rows.orderBy(F.col("ts_ms").desc(), F.col("kafka_offset").desc()).limit(last)
    delay = latency_ms(as_of, F.col("ts_ms"))
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg(delay), 4).alias("mean_ms"),
        F.max(delay).alias("max_ms"),
        F.min(delay).alias("min_ms"),
    )


def latency_percentile(changes: DataFrame, as_of: Column, fraction: float = 0.99) -> DataFrame:
    """Interpolated percentile of the latency of all changes, in milliseconds."""
    rows = changes.filter(F.col("ts_ms").isNotNull()).select(latency_ms(as_of, F.col("ts_ms")).alias("delay"))
    return percentiles(rows, [], "delay", {f"p{round(100 * fraction)}_ms": fraction})


def latency_sketch(ts_ms: Column, k: int = 400) -> Column:
    """An aggregate that keeps the distribution of change times in a few KB, to be stored with a batch."""
    return F.kll_sketch_agg_bigint(ts_ms, k)


def sketched_latency(sketches: DataFrame, as_of: Column, fraction: float = 0.99) -> DataFrame:
    """Percentile of the latency of all changes behind stored sketches (column ``ts_sketch``), without reading the changes.

    The rank of the result is off by about 1 % of the rows at most. Sketches are merged in each task before they
    are shuffled; no sketch gives NULL.
    """
    merged = sketches.filter(F.col("ts_sketch").isNotNull()).agg(F.kll_merge_agg_bigint("ts_sketch").alias("merged"))
    changed = F.when(F.kll_sketch_get_n_bigint("merged") > 0, F.kll_sketch_get_quantile_bigint("merged", F.lit(1 - fraction)))
    return merged.select(latency_ms(as_of, changed).alias(f"p{round(100 * fraction)}_ms"), F.kll_sketch_get_n_bigint("merged").alias("n_rows"))


def value_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequencies of several columns in one pass, most frequent first, NULL left out (A10)."""
    long = rows.select(*[F.col(name).cast("string").alias(name) for name in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    counts = long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("n_rows"))
    return counts.orderBy("column_name", F.col("n_rows").desc(), "value")


def conditional_counts(rows: DataFrame, column: str, values: Mapping[str, object]) -> DataFrame:
    """Total and one count per named value, in one pass (A1)."""
    return rows.agg(
        F.count("*").alias("total"), *[F.count_if(F.col(column) == value).alias(name) for name, value in values.items()]
    )
