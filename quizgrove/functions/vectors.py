"""Vector expressions over array columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIMENSION = 64
#: Words whose place a worker remembers.
WORDS_KEPT = 200_000


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision; the cosine of unit vectors."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, item: total + item)


def l2_norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def _once(value: Column, body) -> Column:
    """``body`` over a value that is evaluated a single time, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(vector: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    with_norm = _once(vector, lambda v: F.struct(v.alias("v"), l2_norm(v).alias("norm")))

    def scaled(pair: Column) -> Column:
        norm = pair.getField("norm")
        return F.transform(pair.getField("v"), lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))

    return _once(with_norm, scaled)


def hashed_embedding(text: Column, dimension: int = HASH_DIMENSION) -> Column:
    """Offline embedding: word counts hashed into ``dimension`` places, then normalised (R1 default).

    A batch of texts at a time; frequent words are digested once a worker.
    """

    class Places(dict):
        def __missing__(self, word: str) -> int:
            place = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dimension
            if len(self) < WORDS_KEPT:
                self[word] = place
            return place

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = Places().__getitem__

        def counts(text: str) -> np.ndarray:
            # str.split knows the same white space as SPACE of the text functions
            places = np.fromiter(map(place, text.split()), dtype=np.int64)
            return np.bincount(places, minlength=dimension).astype(float)

        for batch in batches:
            yield pd.Series([None if x is None else counts(x) for x in batch], dtype=object)

    return l2_normalize(F.pandas_udf(counted, "array<double>")(F.lower(text)))
