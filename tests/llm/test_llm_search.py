"""Ranked search and clustering against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException

from quizgrove.llm import centroids, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, score int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def plain_ranks(docs, items, best=10):
    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [(doc_id, own) for doc_id, own in held if own]
    n_docs, all_terms = len(held), sum(own.total() for _, own in held)
    df = Counter(term for _, own in held for term in own)
    found = []
    for item_id, text in set(items):
        points = []
        for doc_id, own in held:
            m = 25 + 75 * own.total() * n_docs // all_terms
            score = 0
            for term in terms(text):
                if own[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += weight * (1_000_000_000 * own[term] // (1000 * own[term] + 8 * m))
            if score > 0:
                points.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(points)[:best], 1):
            found.append((item_id, rank, doc_id, -score))
    return sorted(found, key=repr)


def test_ranks_across_blocks_owners_and_bundles(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 25)
    monkeypatch.setattr(ranked_search, "BUNDLE_TERMS", 20)
    monkeypatch.setattr(ranked_search, "SENT_ROWS", 5)
    generator = random.Random(2)
    common, rare = ["The", "of", "é1", "a"], [f"w{i}" for i in range(150)]
    docs = [(i // 2, " ".join(generator.choice(common if generator.random() < 0.6 else rare) for _ in range(generator.randint(0, 12)))) for i in range(300)]
    items = [(i, " ".join([*generator.sample(common, 2), *generator.choices(rare, k=i % 5)])) for i in range(12)] + [(3, "the the THE"), (5, "a")]
    found = ranked_search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_ranks(docs, items)


def test_search_edges(spark):
    docs = [(1, "A cat, a CAT"), (1, "A cat, a CAT"), (2, None), (3, ""), (None, "cat"), (4, "--- \n"), (5, "dog " * 30_000), (6, "Dog É"), (7, "x" * 200_000)]
    items = [(1, "cat"), (1, "cat"), (2, None), (3, "  "), (None, "dog dog é"), (4, "unseen"), (1, "dog"), (8, "x" * 200_000)]
    table = spark.createDataFrame([(*row, "x", 1) for row in docs], DOCS)
    asked = spark.createDataFrame([(*row, 1) for row in items], "item_id long, text string, rank int")
    found = ranked_search.ranked(table, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    wanted = plain_ranks([row for row in docs], [row for row in items if row[1]])
    assert sorted(map(tuple, found.collect()), key=repr) == wanted
    assert ranked_search.ranked(table.limit(0), asked).collect() == [] and ranked_search.ranked(table, asked.limit(0)).collect() == []
    assert ranked_search.ranked(table.filter("text IS NULL"), asked).collect() == []


def test_ties_beyond_the_last_rank(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 7)
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(100 + i, "others") for i in range(60)]
    found = ranked_search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "same here")], "item_id long, text string"))
    assert [row["doc_id"] for row in sorted(found.collect(), key=lambda row: row["rank"])] == list(range(1, 11))


def plain_clusters(rows, count, rounds):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda row: (hashlib.sha256(f"1:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]))
    centers = [v for _, v in first[:count]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        labels = [near(v)[1] for _, v in kept]
        for j in set(labels):
            own = [v for (_, v), label in zip(kept, labels, strict=True) if label == j]
            centers[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    final = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in final:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted([(i, j, d, inertia[j], inertia.total(), digest[j]) for i, d, j in final], key=repr)


SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)


def test_clusters_match_plain_version(spark):
    generator = np.random.default_rng(3)
    middles = generator.normal(size=(6, 64)) * 3
    rows = [(i, (middles[i % 6] + generator.normal(size=64) * 0.3).astype(np.float32).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)]  # one hot text, repeated
    rows += [(0, rows[0][1]), (None, rows[1][1]), (None, None), (7, [None] * 64), (8, [float("nan")] * 64), (9, [float("-inf")] + [0.0] * 63), (10, [1.0] * 63), (11, [])]
    found = centroids.cluster_table(vectors(spark, rows))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_clusters(rows, 16, 3)


def test_clusters_of_few_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.01] * 64)]
    assert sorted(map(tuple, centroids.cluster_table(vectors(spark, rows)).collect()), key=repr) == plain_clusters(rows, 16, 3)
    same = [(i, [0.25] * 64) for i in range(20)]
    assert sorted(map(tuple, centroids.cluster_table(vectors(spark, same)).collect()), key=repr) == plain_clusters(same, 16, 3)
    assert centroids.cluster_table(vectors(spark, rows).limit(0)).collect() == []
    with pytest.raises(PySparkException, match="too large"):
        centroids.cluster_table(vectors(spark, [(1, [2.0**20] * 64)])).collect()


def test_bounds_hold_and_spare_distances():
    """No bound exceeds an exact distance, also where both are equal (all points on a line), and most distances are spared."""
    generator = np.random.default_rng(9)
    for scale in (1, 1000, centroids.LARGEST // 2):
        line = generator.integers(-scale, scale + 1, (300, 1)) * np.ones((1, 64), dtype=np.int64)
        cloud = generator.integers(-scale, scale + 1, (300, 64))
        for points in (line, cloud):
            centers = points[:16]
            pivots = centroids.spread_out(centers, 8)
            own, others = centroids.to_pivots(points, pivots), centroids.to_pivots(centers, pivots)
            bounds = centroids.lower_bounds(own, others, centroids.to_pivots(pivots, pivots))
            exact = np.stack([centroids.squared(points, c) for c in centers], axis=1)
            assert (bounds <= exact).all()
            label, best, _ = centroids.assign(points, own, centers, pivots)
            assert np.array_equal(best, exact.min(axis=1)) and np.array_equal(label, exact.argmin(axis=1))
    middles = generator.integers(-2000, 2000, (16, 64))
    points = middles[generator.integers(0, 16, 2000)] + generator.integers(-50, 51, (2000, 64))
    pivots = centroids.spread_out(middles, 8)
    looked = centroids.assign(points, centroids.to_pivots(points, pivots), middles, pivots)[2]
    assert looked < 16 * len(points) // 4
