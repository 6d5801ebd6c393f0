"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_behind(source_date: Column, target_date: Column) -> Column:
    """Whole days from target to source, 0 when one is unknown."""
    return F.coalesce(F.datediff(source_date, target_date), F.lit(0))


def latency_ms(as_of: Column, ts_ms: Column) -> Column:
    """Milliseconds between a change and ``as_of`` (F16)."""
    return F.unix_millis(as_of) - ts_ms


def second_text(moment: Column) -> Column:
    """Date and time without fractions."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def json_field(text: Column, name: str) -> Column:
    """A change attribute, whether or not the connector put ``__`` before its name."""
    return F.coalesce(F.get_json_object(text, f"$.__{name}"), F.get_json_object(text, f"$.{name}"))


def repeatable_id(prefix: str, *parts: Column) -> Column:
    """An id that a retried task produces again."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16))


def label(code: Column, names: Mapping[int, str], default: str) -> Column:
    """Text for a code, with a default for unknown ones."""
    pairs = [F.lit(item) for pair in names.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


# Display names of the type and subject codes.
TYPE_NAMES = {1: "单选", 2: "多选", 3: "填空", 4: "解答"}
SUBJECT_NAMES = {17: "语文", 18: "数学", 19: "英语"}
OTHER_TYPE = "未知"
OTHER_SUBJECT = "其他"
