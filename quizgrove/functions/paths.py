"""Organisation paths: materialised strings such as ``1000/1100``.

Two ways to compare them. ``segment`` compares whole ``/`` segments. ``compat`` removes every slash
first and compares characters, so ``1/1`` also covers ``1/16``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("segment", "compat")


def _checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"path mode must be one of {MODES}, got {mode!r}")
    return mode


def trimmed(path: Column) -> Column:
    return F.trim(path, F.lit("/"))


def path_key(path: Column, mode: str = "segment") -> Column:
    """The comparable form of a path. NULL stays NULL and so matches nothing."""
    if _checked(mode) == "compat":
        return F.replace(path, F.lit("/"), F.lit(""))
    return trimmed(path)


def prefixes(key: Column, mode: str = "segment") -> Column:
    """Every key that covers ``key``: the empty one, each ancestor, and ``key`` itself."""
    if _checked(mode) == "compat":
        return F.transform(F.sequence(F.lit(0), F.length(key)), lambda n: F.substring(key, F.lit(1), n))
    parts = F.split(key, "/")
    below_root = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    return F.when(key == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), below_root))


def strict_prefixes(key: Column, mode: str = "segment") -> Column:
    return F.array_except(prefixes(key, mode), F.array(key))


def covers(upper: Column, lower: Column, mode: str = "segment") -> Column:
    """True when key ``upper`` is ``lower`` or one of its ancestors."""
    if _checked(mode) == "compat":
        return F.startswith(lower, upper)
    return (upper == "") | (lower == upper) | F.startswith(lower, F.concat(upper, F.lit("/")))


def tenant(path: Column) -> Column:
    """First segment."""
    return F.element_at(F.split(trimmed(path), "/"), 1)


def leading(path: Column, count: int) -> Column:
    """The first ``count`` segments, NULL when there are fewer."""
    parts = F.split(trimmed(path), "/")
    return F.when(F.size(parts) >= count, F.array_join(F.slice(parts, 1, count), "/"))


def private_path(tenant_path: Column, user_id: Column) -> Column:
    return F.concat_ws("/", tenant_path, F.lit("PRIVATE"), user_id)


def private_org_id(user_id: Column) -> Column:
    return F.concat(F.lit("PRV_"), user_id)


def fallback_tenant(user_id: Column) -> Column:
    return F.concat(F.lit("T"), user_id)
