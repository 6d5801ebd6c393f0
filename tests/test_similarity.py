from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizgrove.functions.vectors import l2_normalize
from quizgrove.operators import recommend, similarity
from quizgrove.operators.similarity import top_k_similar


def brute(vectors, k, exclude_self=True):
    names = sorted(vectors)
    found = {}
    for a in names:
        scored = [(-round(float(np.dot(vectors[a], vectors[b])), 6), b) for b in names if not (exclude_self and a == b)]
        found[a] = [(b, -s) for s, b in sorted(scored)[:k]]
    return found


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(60, 8))
    rows[10:30] = rows[10]  # a third of all rows are copies
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("limit", [4096, 20])
def test_top_k_equals_brute_force(spark, vectors, limit, as_text):
    table = {(f"q{i:02d}" if as_text else i): v for i, v in enumerate(vectors)}
    kind = "string" if as_text else "long"
    items = spark.createDataFrame([(n, v.tolist()) for n, v in table.items()], f"id {kind}, embedding array<double>")
    items = items.repartition(3)
    found = top_k_similar(
        items.withColumnRenamed("id", "query_id"), items.withColumnRenamed("id", "item_id"), 7,
        broadcast_queries=limit, corpus_block=25,
    ).collect()
    expected = brute(table, 7)
    for name in table:
        mine = sorted((r.rank, r.item_id, r.score) for r in found if r.query_id == name)
        assert [m[1] for m in mine] == [e[0] for e in expected[name]]
        assert np.allclose([m[2] for m in mine], [e[1] for e in expected[name]], atol=2e-6)


def test_larger_k_extends_the_list(spark, vectors):
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    queries, corpus = items.withColumnRenamed("id", "query_id"), items.withColumnRenamed("id", "item_id")
    short = {(r.query_id, r.rank): r.item_id for r in top_k_similar(queries, corpus, 3).collect()}
    long = {(r.query_id, r.rank): r.item_id for r in top_k_similar(queries, corpus, 9).collect()}
    assert short.items() <= long.items() and len(long) == 9 * len(vectors)


def items_frame(spark):
    rows = [
        (1, [1.0, 0.0], 1, "one", 18), (2, [0.9, 0.1], 2, "two", 18), (3, [0.8, 0.2], 1, None, 17), (4, [0.0, 1.0], 1, "four", 18),
    ]
    return spark.createDataFrame(
        rows, "question_id long, embedding array<double>, type_id int, content string, subject_id int"
    )


def test_filters_before_and_after_the_cut(spark):
    items = items_frame(spark)
    asked = recommend.queries_by_id(spark.createDataFrame([(1,)], "query_id long"), items)
    before = recommend.search(asked, items, 1, {"subject_id": 17, "no_column": 1}).collect()
    assert [(r.item_id, r.content) for r in before] == [(3, "")]
    after = recommend.search(asked, items, 1, {"subject_id": 17}, overfetch=2)
    assert after.isEmpty()
    with pytest.raises(ValueError):
        recommend.queries_by_id(spark.createDataFrame([(99,)], "query_id long"), items)


def test_same_type_comes_first(spark):
    items = items_frame(spark)
    rows = recommend.same_type_first(items.select(F.col("question_id").alias("query_id"), "embedding"), items, 4, 2)
    mine = [r.item_id for r in rows.filter("query_id = 1").orderBy("place").collect()]
    assert mine == [3, 4]


def test_recall_of_an_empty_outside_list(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    local = spark.createDataFrame([(1, 5), (1, 6)], "query_id long, item_id long")
    outside = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (1, 7)], "query_id long, ext_id long")
    rows = {r.query_id: r for r in recommend.recall_against(queries, local, outside).collect()}
    assert (rows[1].total, rows[1].matched, rows[1].matched_ids, rows[1].success) == (3, 2, "5,6", False)
    assert (rows[2].total, rows[2].recall, rows[2].success) == (0, 0.0, False)
    lenient = recommend.recall_against(queries, local, outside, empty_is_success=True).filter("query_id = 2").first()
    assert lenient.success
    assert [r.item_id for r in recommend.unmatched(local, outside).collect()] == [7]


def test_embedder_batches_and_retries(spark, tmp_path):
    marker = str(tmp_path / "failed-once")

    def embedder(texts):
        import os

        if not os.path.exists(marker):
            open(marker, "w").close()
            raise RuntimeError("busy")
        assert len(texts) <= 2
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, body string").coalesce(1)
    got = {r.id: r.embedding for r in recommend.embed(rows, "body", embedder, batch_size=2).collect()}
    assert len(got) == 5 and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())


def test_normalising_a_zero_vector(spark):
    row = spark.range(1).select(
        l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("u")
    ).first()
    assert row.z == [0.0, 0.0] and row.u == [0.6, 0.8]


def test_incremental_add_drops_known_repeated_and_empty(spark):
    items = items_frame(spark)
    batch = spark.createDataFrame(
        [(1, "known", 0), (7, "first", 1), (7, "second", 2), (8, "<p></p>", 3), (9, "nine", 4)],
        "question_id long, content string, seq long",
    )
    added = recommend.add_questions(items, batch)
    assert {(r.question_id, r.content) for r in added.collect()} == {(7, "first"), (9, "nine")}
    grown = recommend.append(items, added)
    assert grown.count() == 6 and recommend.add_questions(grown, batch).isEmpty()
    audit = recommend.consistency(grown.select("question_id"), items).first()
    assert (audit.missing, audit.orphans, audit.repeated, audit.consistent) == (2, 0, 0, False)


def test_id_clashes_are_counted(spark):
    ids = spark.createDataFrame([("0",), ("000",), ("5",)], "question_id string")
    assert recommend.consistency(ids, ids).first().id_clashes == 1


def test_provider_rows(spark):
    responses = spark.createDataFrame(
        [('[{"id": 5, "stem": "<b>q</b>", "type_id": 2}, {"id": 6, "stem": null}]',), ("broken",)], "response string"
    )
    rows = recommend.flatten_responses(responses).orderBy("question_id").collect()
    assert [(r.question_id, r.type_id, r.content, r.options) for r in rows] == [(5, 2, "q", ""), (6, 1, "", "")]


def test_an_embedder_runs_once_for_each_query(spark, tmp_path):
    mark = str(tmp_path)

    @F.udf("array<double>")
    def embed(text):
        import os
        import uuid

        open(os.path.join(mark, f"{text}-{uuid.uuid4().hex}"), "w").close()
        return [1.0, 0.0]

    queries = spark.createDataFrame([("a",), ("b",)], "query_id string").withColumn("embedding", embed("query_id"))
    corpus = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "item_id string, embedding array<double>")
    assert top_k_similar(queries, corpus, 1).count() == 2
    assert sorted(p.name[0] for p in tmp_path.iterdir()) == ["a", "b"]


@pytest.mark.parametrize("points", [1, 7, 64])
def test_pruned_search_is_exact(spark, monkeypatch, points):
    """Clustered vectors of different lengths, ties and a zero vector: the same rows as by scoring all pairs."""
    monkeypatch.setattr(similarity, "REFERENCE_POINTS", points)
    generator = np.random.default_rng(points)
    middles = generator.normal(size=(8, 12)) * 4
    vectors = middles[generator.integers(0, 8, 240)] + generator.normal(size=(240, 12)) * 0.2
    vectors[:5], vectors[5] = vectors[10], 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame([*rows, (999, None)], "item_id long, embedding array<double>")
    queries = corpus.filter("item_id % 2 = 0").withColumnRenamed("item_id", "query_id")
    found = similarity.top_k_similar(queries, corpus, 6, broadcast_queries=20, corpus_block=30)
    wanted = similarity.top_k_similar(queries, corpus, 6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert found.count() == 120 * 6


@pytest.mark.parametrize("limit", [4096, 20])
def test_known_lists_stand_for_the_items_they_came_from(spark, limit):
    """The rows are those of one search over all items: ties, repeated and null query ids, queries without a list, no new items."""
    generator = np.random.default_rng(limit)
    vectors = generator.normal(size=(200, 12))
    vectors[:9], vectors[9], vectors[150:156] = vectors[10], 0, vectors[10]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    asked = [*rows[::3], rows[3], rows[30], (None, rows[4][1]), (777, rows[5][1])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    for first, last in ((120, 200), (3, 150), (0, 80), (200, 200)):
        known = None
        for some in (items.filter(F.col("item_id") < first), items.filter((F.col("item_id") >= first) & (F.col("item_id") < last))):
            known = similarity.saved(top_k_similar(queries, some, 6, broadcast_queries=limit, known=known), "known")
        wanted = top_k_similar(queries, items.filter(F.col("item_id") < last), 6, broadcast_queries=limit)
        assert sorted(map(repr, known.collect())) == sorted(map(repr, wanted.collect())), (first, last)


@pytest.mark.parametrize("size", [1.0, 1e-25, 1e12, 1e20])
def test_scores_are_those_of_double_precision(size):
    """Single precision only finds what may count, near ties and numbers beyond its range included."""
    generator = np.random.default_rng(8)
    items = generator.normal(size=(400, 48))
    items[::2] = items[0] + generator.normal(size=(200, 48)) * 1e-8  # closer than single precision tells apart
    items[7], queries = 0, items[:60] * size
    ids, digits = np.arange(400), 6 - int(np.log10(size))
    for floor in (np.full(60, -np.inf), np.round(np.sort(queries @ items.T, axis=1)[:, -9], digits)):
        rows, found, scores = similarity._at_least(ids[:60], queries, floor, ids, items, 6, digits, True)
        wanted = similarity._best(ids[:60], queries, ids, items, 6, digits, True)
        if size < 1e15 or np.isneginf(floor).all():
            assert (np.lexsort((-scores, rows)) == np.arange(len(rows))).all() and (np.bincount(rows, minlength=60) == 6).all()
        assert np.allclose(scores, wanted[2], rtol=1e-12) and (rows == wanted[0]).all()
        assert np.allclose(np.einsum("ij,ij->i", queries[rows], items[found]), scores, atol=10.0**-digits)


def test_a_round_searches_what_it_adds_only(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "question_id long, embedding array<double>")
    batches = [spark.createDataFrame([(i, [float(i), 1.0], 0) for i in own], "question_id long, embedding array<double>, seq int") for own in ((5, 8), (8,), (9, 10, 2))]
    probes = items.withColumnRenamed("question_id", "query_id")
    marked = spark.createDataFrame([(1, 8), (1, 10), (2, 9), (3, 4)], "query_id long, item_id long")
    searched = []

    def add(known, batch):
        return recommend.new_rows(known, batch, "seq").drop("seq")

    def search(some, known):
        corpus = some.withColumnRenamed("question_id", "item_id")
        searched.append(sorted(r.item_id for r in corpus.collect()))
        return top_k_similar(probes, corpus, 2, known=known)

    grown, rounds = recommend.closed_loop(items, batches, add, search, lambda lists: recommend.ranks_of_marked(lists, marked))
    assert searched == [[0, 1, 2, 3, 4, 5, 8], [], [9, 10]]
    assert sorted(r.question_id for r in grown.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10]
    found = {r.iteration: (r.before, r.added, r.queries, r.successful, r.found, r.recall) for r in rounds.collect()}
    assert found == {0: (6, 1, 3, 0, 1, 0.25), 1: (7, 0, 3, 0, 1, 0.25), 2: (7, 2, 3, 1, 2, 0.5)}


def test_far_cells_are_not_visited():
    generator = np.random.default_rng(1)
    middles = generator.normal(size=(50, 32))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    cell = np.repeat(np.arange(50), 40)
    items = middles[cell] + generator.normal(size=(2000, 32)) * 0.01

    class Points:
        value = middles

    reach = np.linalg.norm(items - middles[cell], axis=1)
    held = [{"cell": c, "n": 40, "reach": reach[cell == c].max(), "size": np.linalg.norm(items[cell == c], axis=1).max()} for c in range(50)]
    bounds = similarity.Bounds(Points, held, 11, 1e-6)
    scores = items @ items.T
    assert (np.maximum.reduceat(scores, np.arange(0, 2000, 40), axis=1) <= bounds._best_possible(items)).all()
    kth = np.sort(np.where(bounds._first(items)[:, cell], scores, -np.inf), axis=1)[:, -10]
    assert similarity.visited_share(bounds, items, kth) < 0.1


def test_a_query_is_sent_once_for_each_pack(spark, monkeypatch):
    """Many small cells: a query meets packs of them, and of items with equal vectors only those that can be listed."""
    generator = np.random.default_rng(3)
    vectors = generator.normal(size=(300, 6))  # no clusters: most cells are visited
    vectors[100:] = vectors[100]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item_id long, embedding array<double>")
    queries, kept, sent = items.withColumnRenamed("item_id", "query_id"), [], []
    save, visit = similarity.saved, similarity._visit

    def counted(df, label):
        kept.extend([df.count()] if label == "cells" else [])
        return save(df, label)

    def counted_visits(visits, *rest):
        sent.append(visits.count())
        return visit(visits, *rest)

    monkeypatch.setattr(similarity, "saved", counted)
    monkeypatch.setattr(similarity, "_visit", counted_visits)
    found = top_k_similar(queries, items, 4, broadcast_queries=10, corpus_block=7).collect()
    assert kept == [105] and sum(sent) <= 2 * similarity.LEAST_PARTS * 300
    expected = brute(dict(enumerate(vectors)), 4)
    for name, wanted in expected.items():
        assert [r.item_id for r in sorted((r for r in found if r.query_id == name), key=lambda r: r.rank)] == [w[0] for w in wanted]


def test_added_texts_are_cleaned_once_and_hashed_in_batches(spark):
    known = spark.createDataFrame([], "question_id bigint")
    batch = spark.createDataFrame([(1, " A　b\x1ca &amp; ", 1), (2, "<p> </p>", 1)], "question_id bigint, content string, seq int")
    added = recommend.add_questions(known, batch)
    plan = added._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<template") == 1 and "md5(" not in plan
    counts = np.zeros(64)
    for word in ("a", "b", "a", "&"):
        counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
    (row,) = added.collect()
    assert row.question_id == 1 and np.allclose(row.embedding, counts / np.linalg.norm(counts), atol=0)
