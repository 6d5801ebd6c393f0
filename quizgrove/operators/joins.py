"""Joins on keys in which NULL is a value like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on equal ``keys``, NULL being equal to NULL; the keys are kept once, from the left side."""
    names = {key: f"{key}_of_right" for key in keys}
    other = right.select(*[F.col(name).alias(names.get(name, name)) for name in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()])
    return left.join(other, same, how).drop(*names.values())
