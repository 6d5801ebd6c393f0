"""Question text: cleaning, assembly, truncation and stable ids, all as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Entities decoded without Python; the ampersand comes last.
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)
# Markup patterns, readable by Java and RE2 alike.
HIDDEN_BLOCKS = (
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
    r"(?is)<template\b.*?</template\s*>",
)
COMMENT = r"(?s)<!--.*?-->"
TAG = r"(?s)</?[A-Za-z!][^>]*>"
ANY_ANGLE = r"(?s)<[^>]+>"
SPACE = (
    r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
# The same for Java alone: printable ASCII is told apart first, before the ranges are tried one by one.
SPACE_IN_JAVA = rf"[[^\x21-\x7E]&&{SPACE[:-1]}]+"
# Fixed values of the text rules.
OPTION_PATTERN = r"[A-D][\.、]"
CIRCLED_ONE = "①"
CHOICE_TYPES = (1, 2)
TEXT_LIMIT = 2000
TOKEN_LIMIT = 8000
TOKENS_KEPT = 7500
TRUNCATED = " [TRUNCATED]"


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(text: Column, full: bool = False) -> Column:
    """Decodes the listed entities; ``full`` covers every named and numeric one in Arrow batches."""
    if full:
        return _unescape(text)
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def _strip_markup(text: Column) -> Column:
    for pattern in (*HIDDEN_BLOCKS, COMMENT, TAG):
        text = F.regexp_replace(text, pattern, " ")
    return text


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE_IN_JAVA, " "))


def clean_html(raw: Column, *, full_entities: bool = False, compat: bool = False) -> Column:
    """Plain text of an HTML fragment; NULL becomes the empty string (F1).

    ``compat`` also removes any ``<...>`` run, including inequalities such as ``x<3 and y>2``.
    """
    raw = F.coalesce(raw, F.lit(""))
    text = decode_entities(raw, full_entities)
    text = decode_entities(_strip_markup(text), full_entities)
    text = F.regexp_replace(F.regexp_replace(text, COMMENT, " "), ANY_ANGLE if compat else TAG, " ")
    # neither markup nor an entity begins otherwise
    marked = F.contains(raw, F.lit("<")) | F.contains(raw, F.lit("&"))
    return squeeze(F.when(marked, text).otherwise(raw))


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *[F.nullif(part, F.lit("")) for part in parts])


def build_text(
    content: Column, options: Column, answer: Column, analysis: Column, type_id: Column,
    *, only_stem: bool = True, limit: int = TEXT_LIMIT, compat: bool = False,
) -> Column:
    """The text of a question; choice types bring their options in the full form (F2)."""
    parts = [clean_html(content, compat=compat)]
    if not only_stem:
        is_choice = F.coalesce(type_id.cast("int").isin(*CHOICE_TYPES), F.lit(False))
        parts += [
            F.when(is_choice, clean_html(options, compat=compat)),
            clean_html(answer, compat=compat),
            clean_html(analysis, compat=compat),
        ]
    return F.substring(_joined(parts), 1, limit)


def build_stem_with_options(content: Column, options: Column, type_id: Column) -> Column:
    """Stem plus options for choice types: 1, 2, or any code that starts with 10."""
    is_choice = type_id.cast("int").isin(*CHOICE_TYPES) | F.startswith(type_id.cast("string"), F.lit("10"))
    return _joined([clean_html(content), F.when(F.coalesce(is_choice, F.lit(False)), clean_html(options))])


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(squeeze(text), " "), "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def truncate_tokens(text: Column, limit: int = TOKEN_LIMIT, keep: int = TOKENS_KEPT, mark: str = TRUNCATED) -> Column:
    """Texts over ``limit`` word tokens keep the first ``keep`` and a mark."""
    words = tokens(text)
    return F.when(F.size(words) > limit, F.concat(F.array_join(F.slice(words, 1, keep), " "), F.lit(mark))).otherwise(text)


def stable_id(question_id: Column) -> Column:
    """A positive 64-bit id: short digit strings keep their number, others hash."""
    text = question_id.cast("string")
    head = F.conv(F.substring(F.sha1(text), 1, 16), 16, -10).cast("bigint")
    hashed = head.bitwiseAND(F.lit(2**63 - 1))
    is_short_number = text.rlike(r"^[0-9]{1,18}$")
    return F.when(is_short_number, text.try_cast("bigint")).otherwise(
        F.when(hashed == 0, F.lit(1).cast("bigint")).otherwise(hashed)
    )


def preview(text: Column, length: int = 120, ellipsis: str = "") -> Column:
    """The first characters of a text; the ellipsis marks a cut."""
    if not ellipsis:
        return F.substring(text, 1, length)
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit(ellipsis))).otherwise(text)


def percent(value: Column, digits: int = 1) -> Column:
    """``0.1234`` as ``12.3``."""
    return F.round(value * 100, digits)


def looks_like_options(text: Column) -> Column:
    """True for text such as ``A. one B. two`` or ``①`` lists."""
    return text.rlike(OPTION_PATTERN) | F.contains(text, F.lit(CIRCLED_ONE))


def contains_marker(text: Column, marker: str) -> Column:
    """Substring test; NULL counts as no."""
    return F.coalesce(F.contains(text, F.lit(marker)), F.lit(False))
