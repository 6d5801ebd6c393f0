"""Repeated passages by hashing lines and sentences (operator 3).

Units are the parts of a text between line ends, or between those and the ends of sentences, or paragraphs
between blank lines. A unit's words, in lower case (A-Z only) and joined by single spaces, are its normal form; units without
words belong to the one before them. What is hashed are links: two units in a row, and single units that are long
enough by themselves. Digests are grouped globally; the first document (by id, null first, then by a hash of the text) that
holds a link keeps it. In other documents a run of such links goes if its units have ``MIN_WORDS`` words or more in
all, however short each line or sentence is. Their places in the original text are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizgrove.llm.common import text_key
from quizgrove.session import saved

#: Words of a run that goes: fewer repeat by chance, and a passage of 50 begins and ends within a sentence.
MIN_WORDS = 30

BLANK = r"[\x20\x09-\x0D]"
SEPARATORS = {
    "line": re.compile(r"\n"),
    "sentence": re.compile(rf"(?<=[.!?]){BLANK}+|\n"),
    "paragraph": re.compile(rf"\n[\x20\x09\x0B-\x0D]*\n{BLANK}*"),
}
SPANS = "array<struct<start: int, end: int>>"
CUT = f"text string, spans {SPANS}, n_removed_words long, n_shared_words long"


def units_of(text: str, unit: str) -> tuple[list[int], list[int], list[bytes]]:
    """Begin, number of words and normal form of each unit with words; a unit reaches to the next one's begin."""
    begins, counts, forms = [], [], []
    start = 0
    for cut in [*SEPARATORS[unit].finditer(text), None]:
        end = cut.end() if cut else len(text)
        found = text[start:end].encode("utf-8", "surrogatepass").lower().split()  # only ASCII is lowered and split at
        if found:
            begins.append(start)
            counts.append(len(found))
            forms.append(b" ".join(found))
        start = end
    return begins, counts, forms


def links_of(text: str, unit: str, min_words: int) -> Iterator[tuple[bytes, int]]:
    """Digest and place of each link: 2 * i + 1 for units i and i + 1, 2 * i for a unit that is long enough alone."""
    _, counts, forms = units_of(text, unit)
    for i, form in enumerate(forms):
        if counts[i] >= min_words:
            yield hashlib.blake2b(form, digest_size=16).digest(), 2 * i
        if i + 1 < len(forms):
            yield hashlib.blake2b(form + b"\n" + forms[i + 1], digest_size=16).digest(), 2 * i + 1


def links(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """digest, doc_id, text_key and place of each link."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, places, counts = [], [], []
            for text in batch.column("text"):
                before = len(digests)
                for digest, place in links_of(text.as_py(), unit, min_words):
                    digests.append(digest)
                    places.append(place)
                counts.append(len(digests) - before)
            row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            columns = [pa.array(digests, pa.binary()), batch.column("doc_id").take(row), batch.column("text_key").take(row), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "doc_id", "text_key", "place"])

    return rows.filter("text IS NOT NULL").mapInArrow(cut, "digest binary, doc_id long, text_key long, place int")


def marks(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """doc_id, text_key, again (links an earlier document holds) and shared (links that any other document holds).

    A document of any length holds links: a run of 30 words may stand in several shorter documents, part by part.
    Only documents with such links are listed, once each: equal rows (id and text) are one document. A link's
    first document is found by an aggregate that each task begins on its own rows; a link that very many
    documents share is joined back as Spark splits skewed joins. Links are cut anew for that rather than stored.
    """
    of = F.struct("doc_id", "text_key")
    firsts = links(docs, unit, min_words).groupBy("digest").agg(F.min(of).alias("first"), F.max(of).alias("last"))
    firsts = saved(firsts.filter("NOT (first <=> last)").select("digest", "first"), "first-links")
    found = links(docs, unit, min_words).join(firsts, "digest")
    again = F.collect_set(F.when(~of.eqNullSafe(F.col("first")), F.col("place"))).alias("again")
    return found.groupBy("doc_id", "text_key").agg(again, F.collect_set("place").alias("shared"))


def in_runs(places: np.ndarray, counts: np.ndarray, min_words: int) -> np.ndarray:
    """Which units lie in a run of links whose units have ``min_words`` words or more in all."""
    chosen = np.zeros(len(counts), dtype=bool)
    chosen[places[places % 2 == 0] // 2] = True
    pairs = np.sort(places[places % 2 == 1] // 2)
    if len(pairs):
        before = np.append(0, np.cumsum(counts))
        breaks = np.flatnonzero(np.diff(pairs) > 1)
        begins, ends = pairs[np.append(0, breaks + 1)], pairs[np.append(breaks, len(pairs) - 1)] + 2
        for begin, end in zip(begins, ends, strict=True):
            if before[end] - before[begin] >= min_words:
                chosen[begin:end] = True
    return chosen


def cut_runs(unit: str, min_words: int):
    def one(text: str | None, again, shared) -> tuple:
        if text is None:
            return None, None, 0, 0
        begins, counts, _ = units_of(text, unit)
        counts = np.asarray(counts, dtype=np.int64)
        gone, held = (in_runs(np.asarray(places, dtype=np.int64), counts, min_words) for places in (again, shared))
        kept, place, spans = [], 0, []
        for i in np.flatnonzero(gone).tolist():
            end = begins[i + 1] if i + 1 < len(begins) else len(text)
            kept.append(text[place : begins[i]])
            spans.append({"start": begins[i], "end": end})
            place = end
        return "".join([*kept, text[place:]]), spans or None, int(counts[gone].sum()), int(counts[held].sum())

    def cut(texts: pd.Series, again: pd.Series, shared: pd.Series) -> pd.DataFrame:
        rows = [one(*row) for row in zip(texts, again, shared, strict=True)]
        return pd.DataFrame(rows, columns=["text", "spans", "n_removed_words", "n_shared_words"])

    return F.pandas_udf(cut, CUT)


def without_repeats(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (without the removed units), spans (null: none removed), n_removed_words and n_shared_words of each row.

    ``n_shared_words`` counts the words of runs that other documents hold as well, earlier ones or later ones. Null
    texts stay null and empty ones empty; an empty table gives no rows; other columns are not read. A text of any length is
    cut whole: its units meet in one row of its own. Rows with equal id and text are one document and come out alike.
    """
    found = marks(docs, unit, min_words)
    found = found.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "again", "shared")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    cut = cut_runs(unit, min_words)(F.when(F.col("shared").isNotNull(), F.col("text")), "again", "shared")
    rows = rows.select("doc_id", "text", cut.alias("cut"))
    whole = F.coalesce("cut.text", "text").alias("text")
    counts = [F.coalesce(f"cut.{name}", F.lit(0)).alias(name) for name in ("n_removed_words", "n_shared_words")]
    return rows.select("doc_id", whole, "cut.spans", *counts)


def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without their spans; null where there are none."""

    def one(text: str | None, own) -> str | None:
        if text is None or own is None:
            return None
        kept, place = [], 0
        for span in own:
            kept.append(text[place : span["start"]])
            place = span["end"]
        return "".join([*kept, text[place:]])

    return pd.Series([one(*pair) for pair in zip(texts, spans, strict=True)], dtype=object)


def substring_table(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_removed, removed (start-end of each removed unit, comma-joined), n_chars and text_sha256 of what is left,
    n_removed_words and n_shared_words."""
    return span_table(without_repeats(docs, unit, min_words), "n_removed_words", "n_shared_words")


def span_table(rows: DataFrame, *more: str) -> DataFrame:
    """The columns of ``substring_table`` from doc_id, text and spans."""
    spans = F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"]))
    return rows.select(
        "doc_id",
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(spans, ","), F.lit("")).alias("removed"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
        *more,
    )
