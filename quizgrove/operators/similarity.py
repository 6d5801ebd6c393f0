"""Exact nearest neighbours by inner product.

The query side is counted first. Up to ``broadcast_queries`` rows (fewer for long vectors) it is sent
to every task and the corpus is scanned once, without a shuffle; each task keeps only the best ``k``
of each query. Beyond that the corpus is dealt into cells around reference points, once, and neighbouring cells into
packs of bounded size. A query visits the packs of the most promising cells that hold enough items, and then only packs with a cell
whose bound is not below its k-th score so far; inside a pack it is compared with such cells only:
for an item x in the cell of c, q.x <= q.c + |q| |x - c|, and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 with |q - x| >= |q - c| - |x - c|.
A vector is shuffled once for each pack it meets, never for each cell, and packs are as large as a task holds. Of
items with equal vectors only the lowest ids can be among the best, the others stay behind. Scores in single precision, with a bound on their
error, say which pairs may count; these are scored in double precision.

Lists of a corpus that grows are kept up by searching the new items only, against the k-th scores of the lists known (``known``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizgrove.session import saved

BROADCAST_QUERIES = 4096
BROADCAST_CELLS = 4_000_000  # 32 MB of doubles
BLOCK_BYTES = 64 << 20  # of vectors in a block of the corpus
PART_BYTES = 16 << 20  # of vectors in a shuffled part of the corpus, and in a block of its visitors
LEAST_PARTS = 8  # smaller parts for a small corpus, so that all cores have work
SCORE_CELLS = 4_000_000
SCORED_QUERIES = 1024  # scored and bounded together
#: Reference points, and so cells of the corpus.
REFERENCE_POINTS = 256
_RESULT = "query_id {id_type}, item_id {item_type}, score double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _best(
    query_ids: np.ndarray, queries: np.ndarray, item_ids: np.ndarray, items: np.ndarray,
    k: int, digits: int, exclude_self: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` items per query as (query position, item id, score); ties go to the lower id."""
    parts = []
    step = max(1, SCORE_CELLS // max(1, len(items)))
    for at in range(0, len(queries), step):
        scores = np.round(queries[at : at + step] @ items.T, digits)
        if exclude_self:
            scores[query_ids[at : at + step, None] == item_ids[None, :]] = -np.inf
        keep = scores > -np.inf
        if scores.shape[1] > k:
            floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            keep &= scores >= floor[:, None]
        rows, columns = np.nonzero(keep)
        parts.append(_cut(rows + at, item_ids[columns], scores[rows, columns], k))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def _cut(
    rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - starts < k
    return rows[keep], ids[keep], scores[keep]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def top_k_similar(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    exclude_self: bool = True,
    digits: int = 6,
    broadcast_queries: int = BROADCAST_QUERIES,
    corpus_block: int | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """``query_id, item_id, score, rank`` of the ``k`` most similar items of each query.

    ``queries``: query_id, embedding. ``corpus``: item_id (unique), embedding. Scores are rounded to
    ``digits`` so that equal vectors tie and the lower id wins. The query vectors are saved first, so that an
    embedder runs once for each. At most ``broadcast_queries`` queries and ``corpus_block`` items are scored at a time,
    by default as many as take ``BLOCK_BYTES``; how many meet in a task follows from ``PART_BYTES``.

    ``known`` is what an earlier call with the same queries and ``k`` returned for other items, saved: the result is as if those items
    were in ``corpus`` too, but only this one is searched, and only where it may hold better items than the known ones.
    """
    # the filter comes after, or it would run the embedder a second time
    queries = saved(queries.select("query_id", "embedding"), "query-vectors").filter(F.col("embedding").isNotNull())
    corpus = corpus.select("item_id", "embedding").filter(F.col("embedding").isNotNull())
    schema = _RESULT.format(
        id_type=queries.schema["query_id"].dataType.simpleString(),
        item_type=corpus.schema["item_id"].dataType.simpleString(),
    )
    first = queries.select(F.size("embedding").alias("n")).first()
    width = max(1, first.n if first else 1)
    corpus_block = corpus_block or max(1, BLOCK_BYTES // (8 * width))
    allowed = min(broadcast_queries, max(1, BROADCAST_CELLS // width))
    if queries.limit(allowed + 1).count() <= allowed:
        found = _scan(queries, corpus, schema, k, digits, exclude_self)
        found = found if known is None else found.unionByName(known.select(found.columns))
    else:
        found = _pruned(queries, corpus, schema, k, digits, exclude_self, allowed, corpus_block, width, known)
    return _ranked(found, k)


def _scan(
    queries: DataFrame, corpus: DataFrame, schema: str, k: int, digits: int, exclude_self: bool
) -> DataFrame:
    # Few rows: the caller has counted them.
    local = queries.toPandas()
    shared = corpus.sparkSession.sparkContext.broadcast((local["query_id"].to_numpy(), _matrix(local["embedding"])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix = shared.value
        rows, ids, scores = np.zeros(0, np.int64), None, np.zeros(0)
        for batch in batches:
            if not len(batch) or not len(query_ids):
                continue
            more = _best(
                query_ids, matrix, batch["item_id"].to_numpy(), _matrix(batch["embedding"]), k, digits, exclude_self
            )
            ids = more[1] if ids is None else np.concatenate([ids, more[1]])
            rows, ids, scores = _cut(np.concatenate([rows, more[0]]), ids, np.concatenate([scores, more[2]]), k)
        if ids is not None:
            yield pd.DataFrame({"query_id": query_ids[rows], "item_id": ids, "score": scores})

    return corpus.mapInPandas(search, schema)


def _pruned(
    queries: DataFrame, corpus: DataFrame, schema: str, k: int, digits: int, exclude_self: bool,
    query_block: int, corpus_block: int, width: int, known: DataFrame | None = None,
) -> DataFrame:
    count = min(REFERENCE_POINTS, max(1, BROADCAST_CELLS // width))
    chosen = corpus.orderBy(F.xxhash64("item_id"), "item_id").limit(count).select("embedding").toPandas()  # a bounded number
    known = known if known is None else known.select("query_id", "item_id", "score")
    if chosen.empty:
        return corpus.sparkSession.createDataFrame([], schema) if known is None else known
    points = corpus.sparkSession.sparkContext.broadcast(_matrix(chosen["embedding"]))
    # equal vectors tie with every query and the lower ids win; one id more, as a query's own may be left out
    copies = F.dense_rank().over(Window.partitionBy("embedding").orderBy("item_id"))
    corpus = corpus.withColumn("copy", copies).filter(F.col("copy") <= k + exclude_self).drop("copy")
    cells = saved(corpus.mapInPandas(_assigner(points), f"{_typed(corpus, 'item_id')}, embedding array<double>, cell int, reach double, size double"), "cells")
    held = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach"), F.max("size").alias("size")).collect()  # one row a point
    total = sum(row["n"] for row in held)
    part_rows = max(1, min(PART_BYTES // (8 * width), -(-total // LEAST_PARTS)))
    bounds = Bounds(points, held, k + exclude_self, 10.0**-digits, part_rows)
    search = _searcher(bounds, k, digits, exclude_self, min(query_block, SCORED_QUERIES), corpus_block)

    # each row of a repeated query id counts once for every row of that id; an id that is null has no neighbours
    times = queries.groupBy("query_id").agg(F.count("*").alias("n"))
    queries = queries.join(times, "query_id").select("query_id", "embedding", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("n"))
    queries = saved(queries.drop("n"), "all-queries")

    def visited(asked: DataFrame, visits) -> DataFrame:
        rows = asked.mapInPandas(visits, f"{_typed(queries, 'query_id')}, embedding array<double>, kth double, pack int")
        return _visit(rows, cells, bounds, search, schema, part_rows)

    def reaching(found: DataFrame) -> DataFrame:
        reached = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        asked = queries.join(reached, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        return saved(asked, "asked")

    if known is None:
        first = visited(queries.withColumn("kth", F.lit(float("-inf"))), bounds.first_visits)
    else:
        first = visited(reaching(known), bounds.first_visits).unionByName(known)
    first = saved(_ranked(first, k).drop("rank"), "first-scores")
    return first.unionByName(visited(reaching(first), bounds.further_visits))


def _typed(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"


def _assigner(points: Broadcast):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = _matrix(batch["embedding"])
                cell = (vectors @ points.value.T - (points.value**2).sum(axis=1) / 2).argmax(axis=1)  # the nearest point
                reach, size = np.linalg.norm(vectors - points.value[cell], axis=1), np.linalg.norm(vectors, axis=1)
                yield pd.DataFrame({"item_id": batch["item_id"], "embedding": list(vectors), "cell": cell, "reach": reach, "size": size})

    return assign


class Bounds:
    """Which cells and packs a query visits: numbers per reference point only, whatever the corpus holds."""

    def __init__(self, points: Broadcast, held: list, wanted: int, margin: float, part_rows: int = 1):
        self.points, self.wanted, self.margin = points, wanted, margin
        self.cells = np.array([row["cell"] for row in held])
        self.counts = np.array([row["n"] for row in held])
        self.reach, self.size = (np.array([row[name] for row in held]) for name in ("reach", "size"))
        self.packs = self._packed(part_rows)

    def _packed(self, part_rows: int) -> np.ndarray:
        """The pack of each cell: cells in order along the axis on which they differ most, until they hold ``part_rows`` items."""
        centers = self.points.value[self.cells]
        _, _, axes = np.linalg.svd(centers - centers.mean(axis=0), full_matrices=False)
        order = np.argsort(centers @ axes[0], kind="stable")
        middle = np.cumsum(self.counts[order]) - self.counts[order] / 2
        packs = np.empty(len(order), dtype=np.int64)
        packs[order] = np.unique(middle // part_rows, return_inverse=True)[1]
        return packs

    def _best_possible(self, vectors: np.ndarray, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        """For each query and cell, a score that no item of the cell exceeds."""
        centers, reach, size = self.points.value[self.cells[places]], self.reach[places], self.size[places]
        own = np.linalg.norm(vectors, axis=1)[:, None]
        along = vectors @ centers.T
        apart = np.sqrt(np.maximum(own**2 + (centers**2).sum(axis=1) - 2 * along, 0))
        left = np.maximum(apart * (1 - 1e-9) - reach, 0)
        return np.minimum(along + own * reach, (own**2 + size**2 - left**2) / 2) + 1e-9 * (1 + own * size)

    def _first(self, vectors: np.ndarray) -> np.ndarray:
        """The most promising cells of each query that hold enough items together."""
        return self._promising(self._best_possible(vectors))

    def _promising(self, best: np.ndarray) -> np.ndarray:
        order = np.argsort(-best, axis=1, kind="stable")
        before = np.cumsum(self.counts[order], axis=1) - self.counts[order]
        visited = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(visited, order, before < self.wanted, axis=1)
        return visited

    def _packs_of(self, visited: np.ndarray) -> np.ndarray:
        """Which packs hold a visited cell, for each query."""
        rows, columns = np.nonzero(visited)
        packs = np.zeros((len(visited), self.packs.max() + 1), dtype=bool)
        packs[rows, self.packs[columns]] = True
        return packs

    def _visits(self, batches: Iterator[pd.DataFrame], further: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SCORED_QUERIES):
                some = batch.iloc[at : at + SCORED_QUERIES]
                best = self._best_possible(_matrix(some["embedding"]))
                packs = self._packs_of(self._promising(best))
                if further:
                    packs = self._packs_of(best >= some["kth"].to_numpy()[:, None] - self.margin) & ~packs
                rows, visited = np.nonzero(packs)
                if len(rows):
                    yield some[["query_id", "embedding", "kth"]].iloc[rows].assign(pack=visited.astype(np.int32))

    def first_visits(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return self._visits(batches, False)

    def further_visits(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Packs not visited first that may hold an item as good as the k-th found, rounding included."""
        return self._visits(batches, True)


def _visit(visits: DataFrame, cells: DataFrame, bounds: Bounds, search, schema: str, part_rows: int) -> DataFrame:
    """The best items of each visited part of a pack for each of its visitors."""
    spark = visits.sparkSession
    visitors = {row["pack"]: row["n"] for row in visits.groupBy("pack").agg(F.count("*").alias("n")).collect()}  # one row a pack
    sizes = np.bincount(bounds.packs, weights=bounds.counts)
    # A pack is more than its bound by a part of a cell; only one with a very large cell is cut.
    cuts = [(int(pack), max(1, int(sizes[pack] / part_rows + 0.5)), -(-int(n) // part_rows)) for pack, n in visitors.items()]
    cut = F.broadcast(spark.createDataFrame(cuts, "pack int, parts int, blocks int"))
    packs = [(int(cell), int(pack)) for cell, pack in zip(bounds.cells, bounds.packs, strict=True)]
    pack_of = F.broadcast(spark.createDataFrame(packs, "cell int, pack int"))

    def numbers(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    # New column names keep the two sides apart when both come from one table.
    left = visits.join(cut, "pack").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    left = left.select(F.col("query_id").alias("asked_id"), F.col("embedding").alias("asked_vector"), "kth", "pack", "block", numbers("parts").alias("part"))
    right = cells.join(pack_of, "cell").join(cut, "pack").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"))
    right = right.select(F.col("item_id").alias("held_id"), F.col("embedding").alias("held_vector"), "cell", "pack", "part", numbers("blocks").alias("block"))
    keys = ["pack", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)


def _searcher(bounds: Bounds, k: int, digits: int, exclude_self: bool, query_block: int, corpus_block: int):
    """Scores a block of queries against a part of a pack, cell by cell, while a cell may reach a query's k-th score."""

    def chunk(query_ids, queries, floor, item_ids, items, places, begins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = bounds._best_possible(queries, places)
        step = max(1, min(corpus_block, SCORE_CELLS // len(queries)))
        rows, ids, scores = np.zeros(0, np.int64), item_ids[:0], np.zeros(0)
        for cell in np.argsort(-best.max(axis=0), kind="stable"):
            for at in range(begins[cell], begins[cell + 1], step):
                asked = np.flatnonzero(best[:, cell] >= floor - bounds.margin)
                if not len(asked):
                    break
                to = min(at + step, begins[cell + 1])
                more = _at_least(query_ids[asked], queries[asked], floor[asked], item_ids[at:to], items[at:to], k, digits, exclude_self)
                if not len(more[0]):
                    continue
                better = np.zeros(len(queries), dtype=bool)
                better[asked[more[0]]] = True
                changed = better[rows]
                parts = np.append(rows[changed], asked[more[0]]), np.append(ids[changed], more[1]), np.append(scores[changed], more[2])
                parts = _cut(*parts, k)
                full, counts = np.unique(parts[0], return_counts=True)
                full, last = full[counts == k], np.cumsum(counts)[counts == k] - 1
                floor[full] = np.maximum(floor[full], parts[2][last])
                rows, ids, scores = (np.append(old[~changed], new) for old, new in zip((rows, ids, scores), parts, strict=True))
        return rows, ids, scores

    def search(asked: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(items):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        items = items.sort_values("cell", kind="stable")
        item_ids, vectors = items["held_id"].to_numpy(), _matrix(items["held_vector"])
        cells, begins = np.unique(items["cell"].to_numpy(), return_index=True)
        begins = np.append(begins, len(items))
        places = np.flatnonzero(np.isin(bounds.cells, cells))
        places = places[np.argsort(bounds.cells[places])]
        query_ids, queries, floors = asked["asked_id"].to_numpy(), _matrix(asked["asked_vector"]), asked["kth"].to_numpy()
        nearest = [bounds._best_possible(queries[at : at + query_block], places).argmax(axis=1) for at in range(0, len(queries), query_block)]
        order = np.argsort(np.concatenate(nearest), kind="stable")  # queries that look into the same cells are scored together
        parts = []
        for at in range(0, len(order), query_block):
            own = order[at : at + query_block]
            rows, ids, scores = chunk(query_ids[own], queries[own], floors[own], item_ids, vectors, places, begins)
            parts.append((query_ids[own][rows], ids, scores))
        return pd.DataFrame(dict(zip(("query_id", "item_id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    return search


def _at_least(
    query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, item_ids: np.ndarray, items: np.ndarray,
    k: int, digits: int, exclude_self: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items that may be among the best ``k``, of scores not below ``floor``, as (query position, item id, score)."""
    scores, off = _rough(queries, items)
    margin = 10.0**-digits + off
    bar, unknown = floor - margin, np.flatnonzero(np.isneginf(floor))
    if len(unknown):
        some = scores[unknown]
        if exclude_self:
            some[query_ids[unknown, None] == item_ids[None, :]] = -np.inf
        if some.shape[1] > k:
            bar[unknown] = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] - margin[unknown] - off[unknown]
        scores[unknown] = some
    bar = np.nextafter(bar.astype(scores.dtype), scores.dtype.type(-np.inf))
    places = np.flatnonzero(scores >= bar[:, None])
    rows, columns = np.divmod(places, len(items))
    if scores.dtype == np.float32:
        exact = _exact(queries, items, rows, columns)
        found = np.round(np.where(np.isneginf(scores.ravel()[places]), -np.inf, exact), digits)
    else:
        found = np.round(scores.ravel()[places], digits)
    keep = (found >= floor[rows]) & (found > -np.inf)
    if exclude_self:
        keep &= query_ids[rows] != item_ids[columns]
    return _cut(rows[keep], item_ids[columns[keep]], found[keep], k)


def _rough(queries: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scores in single precision, which takes half the time, and how far those of each query may be off.

    Numbers that it could not hold are scored in double precision.
    """
    sizes = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    most = np.sqrt(np.einsum("ij,ij->i", items, items).max(initial=0.0))
    if not max(most, sizes.max(initial=0.0)) < 1e15:  # nor NaN
        return queries @ items.T, np.zeros(len(queries))
    off = sizes * most * (queries.shape[1] + 8) * 2.0**-23 + 1e-15
    return queries.astype(np.float32) @ items.astype(np.float32).T, off


def _exact(queries: np.ndarray, items: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The scores of the pairs at ``rows`` and ``columns`` in double precision."""
    if 8 * len(rows) > len(queries) * len(items):
        return (queries @ items.T)[rows, columns]
    step = max(1, SCORE_CELLS // max(1, queries.shape[1]))
    parts = [np.einsum("ij,ij->i", queries[rows[at : at + step]], items[columns[at : at + step]]) for at in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def visited_share(bounds: Bounds, vectors: np.ndarray, kth: np.ndarray) -> float:
    """Share of all pairs that are scored for queries whose k-th scores after the first visits are given."""
    best = bounds._best_possible(vectors)
    visited = bounds._promising(best) | (best >= kth[:, None] - bounds.margin)
    return float((visited @ bounds.counts).sum() / (len(vectors) * bounds.counts.sum()))
