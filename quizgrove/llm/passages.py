"""Repeated passages wherever they stand, in short lines or inside long ones (operator 3).

The units are words (A-Z in lower case) and the length condition is on the run of them: of the equal windows of
``min_words`` words the first stays, by document id (null first), a hash of the text and place; the words of the others go.

Few windows are looked at one by one. The least hash of the shorter runs (grams) inside a window depends on the window's
words only, so equal windows have an equal least gram. Windows whose least gram stands at one place of all texts can't
repeat; of the others digests of 128 bits are compared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizgrove.llm.common import text_key
from quizgrove.llm.substring import SPANS, cut_out, span_table
from quizgrove.session import saved

#: Words of the windows that are compared.
MIN_WORDS = 20
#: Words whose hashes a worker keeps.
CACHED_WORDS = 200_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text_key long"


class WordHashes(dict):
    """128 bits of each word."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = hashlib.blake2b(word, digest_size=16).digest()
        return found


def hashes_of(text: str, cache: WordHashes) -> np.ndarray:
    """Two columns of 64 bits, one row a word."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # only ASCII is lowered and split at
    return np.frombuffer(b"".join(map(cache.__getitem__, found)), dtype="<u8").reshape(-1, 2)


def multipliers(size: int, label: str) -> np.ndarray:
    """Odd numbers of 64 bits, one for each place in a window, so that the order of words counts."""
    own = b"".join(hashlib.blake2b(f"{label}/{i}".encode(), digest_size=8).digest() for i in range(size))
    return np.frombuffer(own, dtype="<u8") | np.uint64(1)


def rolled(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A hash of each run of ``len(by)`` values."""
    count = len(values) - len(by) + 1
    found = np.zeros(count, dtype="<u8")
    for i, one in enumerate(by):
        found += values[i : i + count] * one
    return found


def every_gram(hashes: np.ndarray, min_words: int) -> np.ndarray:
    """The hash of each gram; a gram has half of a window's words."""
    return rolled(hashes[:, 0], multipliers((min_words + 1) // 2, "gram"))


def least_grams(hashes: np.ndarray, min_words: int) -> np.ndarray:
    """The least hash of the grams inside each window."""
    found = every_gram(hashes, min_words)
    return np.lib.stride_tricks.sliding_window_view(found, min_words - (min_words + 1) // 2 + 1).min(axis=1)


def grams(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_key, gram and n: the windows' least grams, once a document, and how often each stands there (2: more than once)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = hashes_of(text, cache)
                if len(hashes) < min_words:
                    continue
                least = np.unique(least_grams(hashes, min_words))
                known, count = np.unique(every_gram(hashes, min_words), return_counts=True)
                often = np.minimum(count[np.searchsorted(known, least)], 2)
                same = [pa.array([value] * len(least), type=pa.int64()) for value in (doc_id, key)]
                columns = [*same, pa.array(least.view("<i8")), pa.array(often.astype("int32"))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "gram", "n"])

    return docs.mapInArrow(cut, f"{DOC}, gram long, n int")


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_key, start (in words) and high and low (the digest) of each window whose least gram is in ``grams``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        high, low = multipliers(min_words, "high"), multipliers(min_words, "low")
        for batch in batches:
            repeated = batch.column(3)
            for row, (doc_id, key, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                hashes = hashes_of(text, cache)
                wanted = repeated[row].values.to_numpy(zero_copy_only=False).view("<u8")
                start = np.flatnonzero(np.isin(least_grams(hashes, min_words), wanted))
                same = [pa.array([value] * len(start), type=pa.int64()) for value in (doc_id, key)]
                digest = [rolled(hashes[:, i], by)[start].view("<i8") for i, by in enumerate((high, low))]
                columns = [*same, pa.array(start.astype("int32")), *map(pa.array, digest)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "start", "high", "low"])

    return docs.mapInArrow(cut, f"{DOC}, start int, high long, low long")


def same_doc(left: str, right: str) -> Column:
    """An equal id, null included, and an equal text."""
    return F.col(f"{left}doc_id").eqNullSafe(F.col(f"{right}doc_id")) & (F.col(f"{left}text_key") == F.col(f"{right}text_key"))


def of_doc(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(F.col("doc_id").alias("of_doc_id"), F.col("text_key").alias("of_text_key"), *names)


def repeated_words(rows: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_key and runs of removed words, each packed in a long: 2^32 times its start, plus its end.

    ``rows``: doc_id, text_key and text. Equal rows (id and text) are one document. A window that overlaps the first
    of its kind gives only the words behind that one, so that the first stays whole.
    """
    texts = rows.filter("text IS NOT NULL")
    own = saved(grams(texts, min_words), "passage-grams")
    often = saved(own.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"), "repeated-grams")
    by_doc = of_doc(own.join(often, "gram"), "gram").groupBy("of_doc_id", "of_text_key").agg(F.collect_set("gram").alias("grams"))
    chosen = texts.join(by_doc, same_doc("", "of_")).select("doc_id", "text_key", "text", "grams")
    found = saved(windows(chosen, min_words), "passage-windows")
    place = F.struct("doc_id", "text_key", "start")
    firsts = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = saved(firsts.filter("NOT (first <=> last)").select("high", "low", "first"), "first-windows")
    again = found.join(firsts, ["high", "low"]).filter(~place.eqNullSafe(F.col("first")))
    behind = F.greatest(F.col("start"), F.col("first.start") + min_words)
    begin = F.when(same_doc("", "first."), behind).otherwise(F.col("start")).cast("long")
    end = (F.col("start") + min_words).cast("long")
    again = again.select("doc_id", "text_key", begin.alias("begin"), end.alias("end")).filter("begin < end")
    packed = F.shiftleft("begin", 32) + F.col("end")
    return again.groupBy("doc_id", "text_key").agg(F.collect_set(packed).alias("runs"))


def char_spans(texts: pd.Series, runs: pd.Series) -> pd.Series:
    """Runs of words, merged, as places in the text.

    A run that begins a line takes the blanks after it along, another one the blanks before it.
    """

    def one(text: str | None, own) -> list | None:
        if text is None or own is None:
            return None
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        own = np.asarray(own, dtype=np.int64)
        np.add.at(gone, own >> 32, 1)
        np.add.at(gone, own & 0xFFFFFFFF, -1)
        edges = np.flatnonzero(np.diff(np.cumsum(gone[:-1]) > 0, prepend=False, append=False))
        spans = []
        for begin, end in edges.reshape(-1, 2).tolist():
            before = words[begin - 1][1] if begin else 0
            after = words[end][0] if end < len(words) else len(text)
            if begin == 0 or "\n" in text[before : words[begin][0]]:
                spans.append({"start": words[begin][0], "end": after})
            else:
                spans.append({"start": before, "end": words[end - 1][1]})
        return spans

    return pd.Series([one(*pair) for pair in zip(texts, runs, strict=True)], dtype=object)


def without_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (without the removed words) and spans (null: none removed) of each row of ``docs``.

    Null texts stay null and empty ones empty; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    removed = of_doc(repeated_words(rows, min_words), "runs")
    rows = rows.join(removed, same_doc("", "of_"), "left")
    places, cut = F.pandas_udf(char_spans, SPANS), F.pandas_udf(cut_out, "string")
    some = F.when(F.col("runs").isNotNull(), F.col("text"))
    rows = rows.select("doc_id", "text", places(some, F.col("runs")).alias("spans"))
    shorter = cut(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans"))
    return rows.select("doc_id", F.coalesce(shorter, F.col("text")).alias("text"), "spans")


def passage_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_removed, removed (start-end of each removed span, comma-joined), n_chars and text_sha256 of what is left."""
    return span_table(without_passages(docs, min_words))
