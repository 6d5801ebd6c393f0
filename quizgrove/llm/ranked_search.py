"""Ranked lexical search by pipelined term partitioning (operator 11).

The index is dealt in two ways: documents lie in blocks of bounded size, and the terms that the items ask for have
owners, the rarest terms the first. Items travel in bundles. In each block a bundle carries the accumulators
(item, document, score so far) from owner to owner; an owner's stage is a cogroup of the accumulators with its lists,
which adds its terms' integer contributions. The last stage gives each item's best documents of the
block, and the best of all blocks are the result.

After each stage accumulators go that can't be among the best any more: as many documents of the same block as are wanted
have more points already than the accumulator could reach with all points that the later owners' terms can
give. That loses nothing; an accumulator that begins anew later holds fewer points than its
document has and stays below the same bound.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizgrove.llm.common import ascii_lower
from quizgrove.llm.decontaminate import words
from quizgrove.session import saved

BEST = 10
#: Fixed values of the score.
B, SCALE = 75, 1_000_000_000
#: Bounds of a block; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 4096, 1 << 23
#: Owners, and so stages.
OWNERS = 4
#: Terms (of items, with those they share) in a bundle, on average.
BUNDLE_TERMS = 1 << 14
#: A small side of a join is sent to all executors if it was counted and measured to stay below these.
SENT_ROWS, SENT_BYTES = 100_000, 1 << 23

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
INDEX_DDL = "block long, term binary, n_docs long, n_terms long, places binary, counts binary, doc_ids array<long>"
INDEX = pa.schema(
    [("block", pa.int64()), ("term", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("places", pa.binary()),
     ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]
)


def index(docs: DataFrame) -> DataFrame:
    """The index, saved. For each block one row per term (the places of its documents in the block, and how often each
    holds it) and one without a term (the ids of the block's documents, and how many terms each has).

    Documents without terms are left out.
    """
    rows = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("content"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True):
                held.add(doc_id, content.as_py())
                if len(held.doc_ids) == BLOCK_DOCS or held.size >= BLOCK_BYTES:
                    yield from held.rows(block)
                    block, held = block + 1, Block()
        if held.doc_ids:
            yield from held.rows(block)

    return saved(rows.mapInArrow(build, INDEX_DDL), "term-index")


class Block:
    """A block while its documents are read."""

    def __init__(self):
        self.size = 0
        self.numbers: dict[bytes, int] = {}
        self.doc_ids, self.lengths, self.distinct, self.terms, self.counts = [], [], [], [], []

    def add(self, doc_id: int | None, content: bytes) -> None:
        found = Counter(TERM.findall(content.lower()))
        self.size += len(content)
        if found:
            numbers = self.numbers
            self.doc_ids.append(doc_id)
            self.lengths.append(found.total())
            self.distinct.append(len(found))
            self.terms += [numbers.setdefault(term, len(numbers)) for term in found]
            self.counts += found.values()

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        lengths = np.asarray(self.lengths, dtype=np.int64)
        head = [[block], [None], [len(lengths)], [int(lengths.sum())], [b""], [lengths.astype("<i8").tobytes()], [self.doc_ids]]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=field.type) for x, field in zip(head, INDEX, strict=True)], schema=INDEX)
        if self.numbers:
            terms = np.asarray(self.terms, dtype=np.int64)
            order = np.argsort(terms, kind="stable")
            places = np.repeat(np.arange(len(lengths), dtype="<i4"), self.distinct)[order]
            counts = np.asarray(self.counts, dtype="<i4")[order]
            ends = np.cumsum(np.bincount(terms, minlength=len(self.numbers)))
            begins, own = np.append(0, ends[:-1]), list(self.numbers)
            for low in range(0, len(own), 20_000):
                cut = slice(low, low + 20_000)
                spans = list(zip(begins[cut].tolist(), ends[cut].tolist(), strict=True))
                size = len(spans)
                columns = [[block] * size, own[cut], [e - b for b, e in spans], [0] * size, [places[b:e].tobytes() for b, e in spans],
                           [counts[b:e].tobytes() for b, e in spans], [None] * size]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=field.type) for x, field in zip(columns, INDEX, strict=True)], schema=INDEX)


def sent(df: DataFrame, width: Column) -> DataFrame:
    """``df`` (a saved table with ``width`` bytes a row) with a broadcast hint if it was measured to be small, else as it is."""
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= SENT_ROWS and found["bytes"] <= SENT_BYTES else df


def numbered(items: DataFrame) -> DataFrame:
    """item_id, text and a number for each different row that has a text."""
    rows = items.select("item_id", "text").filter("text IS NOT NULL").distinct()
    return saved(rows.withColumn("item", F.monotonically_increasing_id()), "items")


def weighted_terms(items: DataFrame, postings: DataFrame, n_docs: int, best_factor: int = 1_000_000) -> DataFrame:
    """item, term, gain (weight times repeats), most (the points it can give) and owner of each term that can give any."""
    asked = items.select("item", F.explode(F.transform(words(F.col("text")), ascii_lower)).alias("word"))
    asked = saved(asked.groupBy("item", F.col("word").cast("binary").alias("term")).agg(F.count("*").alias("repeats")), "item-terms")
    different = saved(asked.select("term").distinct(), "asked-terms")
    lists = postings.join(sent(different, F.octet_length("term")), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    lists = saved(lists.withColumn("weight", weight).filter("weight > 0"), "term-weights")
    steps = [i / OWNERS for i in range(1, OWNERS)]
    bounds = lists.agg(F.percentile_approx("df", steps).alias("b")).first()["b"] or []
    owner = sum(((F.col("df") > bound).cast("int") for bound in bounds), F.lit(0))
    gain = F.col("weight") * F.col("repeats")
    return asked.join(sent(lists, F.octet_length("term")), "term").select("item", "term", gain.alias("gain"), (gain * best_factor).alias("most"), owner.alias("owner"))


def bundled(terms: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Terms with their bundle's number, the items of each bundle with the points that each owner's terms can give, and the number of bundles."""
    terms = saved(terms, "weighted-terms")
    count = max(1, -(-terms.count() // BUNDLE_TERMS))
    terms = terms.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(count)).cast("int"))
    most = [F.sum(F.when(F.col("owner") == i, F.col("most")).otherwise(0)).alias(f"m{i}") for i in range(OWNERS)]
    each = terms.groupBy("bundle", "item").agg(*most)
    lists = each.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("item", *[f"m{i}" for i in range(OWNERS)]))).alias("items"))
    columns = [F.col("items")["item"].alias("items"), *[F.col("items")[f"m{i}"].alias(f"m{i}") for i in range(OWNERS)]]
    return terms, saved(lists.select("bundle", *columns), "bundles"), count


def longs(cell: pa.Scalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False).astype(np.int64)


def raw(cell: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(cell.as_py(), dtype=kind)


def stage(owner: int, n_docs: int, n_terms: int, best: int):
    """The work of one owner on a block and a bundle: its contributions added to the accumulators that came in."""
    last = owner == OWNERS - 1

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("lists of a block that has no documents")
        row = {name: left.column(name)[0] for name in left.column_names}
        lengths, items = raw(row["lengths"], "<i8"), longs(row["items"])
        m = 100 - B + (B * lengths * n_docs) // n_terms
        scores = np.zeros((len(items), len(lengths)), dtype=np.int64)
        scores[raw(row["at_item"], "<i4"), raw(row["at_doc"], "<i4")] = raw(row["points"], "<i8")
        for places, counts, asking, gains in zip(*(right.column(name) for name in ("places", "counts", "asking", "gains")), strict=True):
            docs, tf = raw(places, "<i4"), raw(counts, "<i4").astype(np.int64)
            points = (SCALE * tf) // (1000 * tf + 8 * m[docs])
            for item, gain in zip(np.searchsorted(items, longs(asking)).tolist(), longs(gains).tolist(), strict=True):
                scores[item, docs] += gain * points
        rest = sum((longs(row[f"m{i}"]) for i in range(owner + 1, OWNERS)), np.zeros(len(items), dtype=np.int64))
        reached = np.zeros(len(items), dtype=np.int64)
        if scores.shape[1] >= best:
            reached = np.partition(scores, scores.shape[1] - best, axis=1)[:, -best]
        at_item, at_doc = np.nonzero((scores > 0) & (scores + rest[:, None] >= reached[:, None]))
        points = scores[at_item, at_doc]
        if not last:
            columns = {"at_item": at_item.astype("<i4"), "at_doc": at_doc.astype("<i4"), "points": points.astype("<i8")}
            for name, values in columns.items():
                left = left.set_column(left.column_names.index(name), name, pa.array([values.tobytes()], pa.binary()))
            return left
        ids = row["doc_ids"].values.take(pa.array(at_doc))
        return pa.table({"item": pa.array(items[at_item], pa.int64()), "doc_id": ids, "score": pa.array(points, pa.int64())})

    return add


ACCUMULATORS = (
    "block long, bundle int, doc_ids array<long>, lengths binary, items array<long>, "
    + "".join(f"m{i} array<long>, " for i in range(OWNERS))
    + "at_item binary, at_doc binary, points binary"
)


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score: each item's ``best`` documents with a score above 0.

    Equal scores are ranked by document id (null first). Every row of ``docs`` is a document, rows that repeat or
    share an id too; rows of ``items`` that are equal are one item, others that share an id are ranked each. Null and
    empty texts and texts without terms have no terms and are in no result; empty tables give no rows. A text of any length is
    indexed whole. Other columns aren't read. What a task holds follows the size of a block and of a bundle only.
    """
    stored = index(docs)
    heads, postings = stored.filter("term IS NULL"), stored.filter("term IS NOT NULL").select("block", "term", "n_docs", "places", "counts")
    n_docs, n_terms = heads.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    items = numbered(items)
    terms, bundles, count = bundled(weighted_terms(items, postings, n_docs))
    empty = F.lit(b"")
    carried = heads.select("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bundle"), "doc_ids", F.col("counts").alias("lengths"))
    carried = carried.join(bundles, "bundle").withColumns({"at_item": empty, "at_doc": empty, "points": empty})
    carried = carried.select(*(column.split()[0] for column in ACCUMULATORS.split(", ")))
    asked = terms.groupBy("owner", "bundle", "term").agg(F.collect_list(F.struct("item", "gain")).alias("asking"))
    asked = saved(asked.select("owner", "bundle", "term", F.col("asking")["item"].alias("asking"), F.col("asking")["gain"].alias("gains")), "asked-lists")
    for owner in range(OWNERS):
        own = sent(asked.filter(F.col("owner") == owner).drop("owner"), F.octet_length("term") + 16 * F.size("asking"))
        lists = postings.join(own, "term")
        lists = lists.select(F.col("block").alias("of_block"), F.col("bundle").alias("of_bundle"), "places", "counts", "asking", "gains")
        result = "item long, doc_id long, score long" if owner == OWNERS - 1 else ACCUMULATORS
        work = stage(owner, n_docs, n_terms, best)
        carried = carried.groupBy("block", "bundle").cogroup(lists.groupBy("of_block", "of_bundle")).applyInArrow(work, result)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    found = carried.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return found.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
