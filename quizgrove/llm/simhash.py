"""SimHash near-duplicates by pigeonring filtering (operator 6).

A fingerprint's 64 bits are m segments in a ring. If two fingerprints differ in at most k bits, there is a
segment from which on every chain of l segments differs in at most l * k / m bits (Qin and Xiao's pigeonring
principle). For k = 4 and five segments the chain's first segment must be equal and its first two may differ in one bit: that is an
equi-join on both segments, where one side adds the second segment's one-bit changes. Longer chains and
then all 64 bits are checked on the pairs found.

Pairs within a dense group of near copies would be very many, so links are made in two steps. First each
fingerprint is held against the least and the greatest of its bucket, two comparisons a row. Then only buckets that still
hold fingerprints of different components are joined, and only across components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizgrove.llm.common import sent, shuffled, text_key
from quizgrove.llm.components import components
from quizgrove.session import saved

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42


def fingerprint(text: bytes | None, width: int) -> int:
    """A bit is set if it is set in over half of the XXH64 of the word shingles, repeats included."""
    if not text:
        return 0
    words = text.lower().split()  # on bytes both know only ASCII: A-Z, and the six white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    begins = np.append(0, ends[:-width] + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], SEED) for i, j in zip(begins.tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, dtype=np.int64)
    hashes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for first in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[first : first + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(text: Column, width: int) -> Column:
    """The fingerprint as a signed long; zero for texts without words and for null."""

    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x, width) for x in batch], dtype=np.uint64).view(np.int64))

    return F.pandas_udf(hashed, "long")(text.cast("binary"))


def segments_for(most: int) -> int:
    """Enough segments that the first of a chain must be equal and the first two differ in one bit at most."""
    return max(5, most + 1)


def bounds(segments: int) -> list[tuple[int, int]]:
    """The first bit and the length of each segment."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def segment(value: Column, begin: int, length: int) -> Column:
    return F.shiftrightunsigned(value, begin).bitwiseAND(F.lit((1 << length) - 1))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def chained(a: Column, b: Column, start: Column, most: int) -> Column:
    """Whether from segment ``start`` on each chain's differences stay within its share of ``most``."""
    segments, either = segments_for(most), F.lit(False)
    ring = bounds(segments)
    for i in range(segments):
        mask, fits = 0, start == i
        for reach in range(1, segments):
            begin, length = ring[(i + reach - 1) % segments]
            mask |= ((1 << length) - 1) << begin
            chain = F.lit(signed(mask))
            fits &= differing(a.bitwiseAND(chain), b.bitwiseAND(chain)) <= reach * most // segments
        either |= fits
    return either


def keys(prints: DataFrame, most: int) -> DataFrame:
    """print with the key of each bucket that it is in, and whether the bucket is exactly its own.

    Its own are its first two segments from each start on; the others differ from them in one bit of the second.
    Two fingerprints whose chains stay within the budgets from a start on share the own bucket of either.
    """
    segments = segments_for(most)
    ring, parts = bounds(segments), []
    for i in range(segments):
        (a, n), (b, m) = ring[i], ring[(i + 1) % segments]
        first = F.lit(i << 32).bitwiseOR(F.shiftleft(segment(F.col("print"), a, n), m))
        second = segment(F.col("print"), b, m)
        for flip in [0, *(1 << k for k in range(m))] if 2 * most // segments else [0]:
            parts.append(F.struct(first.bitwiseOR(second.bitwiseXOR(F.lit(flip))).alias("key"), F.lit(not flip).alias("own")))
    rows = prints.select("print", F.explode(F.array(*parts)).alias("bucket"))
    return rows.select("print", "bucket.key", "bucket.own")


def linked(prints: DataFrame, most: int) -> DataFrame:
    """print and component (the least fingerprint it is linked to, over any chain) of different fingerprints."""
    buckets = keys(prints, most)
    own = buckets.filter("own")
    n = prints.count()
    n_own = n * segments_for(most)
    # the few own keys are grouped, the many changed ones only looked up among them, once
    owned = saved(own.groupBy("key").agg(F.min("print").alias("least"), F.max("print").alias("top")), "own-buckets", n_own)
    met = saved(buckets.filter("NOT own").join(sent(owned, n_own), "key"), "changed-in-own")
    shared = met.select("key").union(owned.filter("least < top").select("key")).distinct()
    shared = saved(shared.join(sent(owned, n_own), "key"), "shared-buckets", n_own)
    members = met.unionByName(saved(own.join(sent(shared, n_own), "key"), "owners", n_own))
    stars = [
        members.filter((differing(F.col("print"), F.col(hub)) <= most) & (F.col("print") != F.col(hub)))
        .select(F.col(hub).alias("a"), F.col("print").alias("b"))
        for hub in ("least", "top")
    ]
    first = saved(components(stars[0].unionByName(stars[1])), "near-first", n).withColumnRenamed("node", "print")
    members = members.select("key", "print", "own").join(sent(first, n), "print", "left")
    members = members.withColumn("component", F.coalesce("component", "print"))
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = saved(mixed.filter("low < high").select("key", "low"), "mixed-keys", n_own)
    members = saved(members.join(sent(mixed, n_own), "key"), "mixed-buckets")
    # a pair of two components has one at least that isn't the bucket's lowest
    a = members.select("key", F.col("print").alias("p"), F.col("component").alias("a"), F.col("own").alias("own_a"), "low")
    b = members.select(F.col("key").alias("key_b"), F.col("print").alias("q"), F.col("component").alias("b"), F.col("own").alias("own_b"))
    start = F.shiftright(F.col("key"), 32)
    near = chained(F.col("p"), F.col("q"), start, most) & (differing(F.col("p"), F.col("q")) <= most)
    here = (F.col("key") == F.col("key_b")) & (F.col("a") != F.col("b")) & (F.col("own_a") | F.col("own_b"))
    across = a.filter("a <> low").drop("low").join(shuffled(b), here & near).select("a", "b")
    merged = components(across).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    both = prints.select("print").join(sent(first, n), "print", "left").withColumn("component", F.coalesce("component", "print"))
    both = both.join(sent(merged, n), "component", "left")
    return both.select("print", F.coalesce("merged", "component").alias("component"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least id of its component) of each row.

    Fingerprints link at ``most`` or fewer differing bits, zero like any other. Null and empty texts have
    fingerprint zero. Every row is returned, repeated rows too; a null id never names a component unless all ids
    of the component are null. Other columns are not read; an empty table gives no rows.
    """
    found = near_rows(docs, width, most)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def near_rows(docs: DataFrame, width: int, most: int) -> DataFrame:
    """doc_id, tie (a hash of the text), print, component (its least print) and component_id of each row."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("tie"), fingerprints(F.col("text"), width).alias("print"))
    rows = saved(rows, "fingerprints")
    prints = saved(rows.groupBy("print").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints", rows.count())
    n = prints.count()
    groups = saved(linked(prints, most), "near-components", n)
    names = groups.join(sent(prints, n), "print").groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = saved(groups.join(sent(saved(names, "component-ids", n), n), "component"), "near-names", n)
    return rows.join(sent(named, n), "print")


def one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, with their columns, that stand for their component: one of each.

    It is the row with the least id (null ids last); of rows that share it, the one with the least hash of its text;
    of equal rows, one.
    """
    found = near_rows(docs, width, most)
    keyed = (F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    first = found.select("component", F.struct(*keyed).alias("row")).groupBy("component").agg(F.min("row").alias("row"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("tie"), F.struct(*docs.columns).alias("doc"))
    rows = rows.select(*keyed, "doc").groupBy("no_id", "id", "tie").agg(F.first("doc").alias("doc"))
    return rows.join(shuffled(first.select("row.*")), ["no_id", "id", "tie"], "left_semi").select("doc.*")
