"""Exact ranks and percentiles for groups of any size.

Equal values are counted together first. The distinct values of a large group are then cut into ranges
by approximate quantiles, so that a group holding most of the rows is ranked by many tasks; the
result is exact whatever the cuts are. NULL is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizgrove.operators.joins import null_safe_join

RANGES = 256


def _bounds_below(bounds: Column, value: Column, ranges: int) -> Column:
    """How many of fewer than ``ranges`` ascending bounds are below the value, found by halving."""
    steps = F.lit([2**power for power in reversed(range((ranges - 1).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda below, step: below + F.when(F.get(bounds, below + step - 1) < value, step).otherwise(0)
    )


def value_positions(rows: DataFrame, group: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """Per group and distinct value: ``n`` equal rows, ``before`` smaller rows, ``total`` rows."""
    group = list(group)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    cuts = [step / ranges for step in range(1, ranges)]
    bounds = counts.groupBy(*group).agg(F.sort_array(F.percentile_approx(value, cuts, 10 * ranges)).alias("bounds"))
    placed = null_safe_join(counts, bounds, group) if group else counts.withColumn("bounds", bounds.select("bounds").scalar())
    placed = placed.withColumn("value_range", _bounds_below(F.col("bounds"), F.col(value), ranges)).drop("bounds")
    sizes = placed.groupBy(*group, "value_range").agg(F.sum("n").alias("range_rows"))
    # At most ``ranges`` rows per group from here.
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("value_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *group,
        "value_range",
        F.coalesce(F.sum("range_rows").over(earlier), F.lit(0)).alias("start"),
        F.sum("range_rows").over(whole).alias("total"),
    )
    smaller = Window.partitionBy(*group, "value_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("inside", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    return null_safe_join(within, starts, [*group, "value_range"]).select(
        *group, value, "n", (F.col("start") + F.col("inside")).alias("before"), "total"
    )


def percentiles(rows: DataFrame, group: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Interpolated percentiles per group; ``points`` maps output names to fractions."""
    return percentiles_of(value_positions(rows, group, value), group, value, points)


def percentiles_of(positions: DataFrame, group: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """The same from the rows of ``value_positions``."""
    group = list(group)

    def at(index):
        inside = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    parts = []
    for name, fraction in points.items():
        place = F.lit(fraction) * (F.col("total") - 1)
        parts += [
            at(F.floor(place)).alias(f"{name}_low"),
            at(F.ceil(place)).alias(f"{name}_high"),
            F.max(place - F.floor(place)).alias(f"{name}_part"),
        ]
    found = positions.groupBy(*group).agg(*parts)
    return found.select(
        *group,
        *[
            (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")).alias(name)
            for name in points
        ],
    )
