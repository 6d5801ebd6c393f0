"""Corpus queries against their SQL, and the pipeline against its plain version, on the smallest data."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quizgrove.llm import quality
from quizgrove.llm.queries import ORACLE, QUERIES
from quizgrove.session import saved
from tests.llm import brute
from tools.check import rows_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, connection, name):
    found = QUERIES[name](spark, SF_DIR)
    wanted = connection.execute(ORACLE[name])
    columns = [item[0] for item in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, wanted.fetchall())


def test_operators_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) <= names and sum(name.startswith("op") for name in QUERIES) == 13
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_quality_query(spark, connection):
    rows = {r["doc_id"]: r for r in QUERIES["op10_quality"](spark, SF_DIR).collect()}
    texts = connection.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        row, base = rows[doc_id], brute.base_counts(text)
        assert tuple(row[name] for name in quality.BASE) == base
        assert row["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (row["base_failed"] and row["kept"])
    labels = dict(connection.execute("SELECT doc_id, quality FROM labels").fetchall())
    passing = [d for d in labels if not rows[d]["base_failed"]]
    assert all(rows[d]["kept"] for d in passing if labels[d] == 1)
    assert not any(rows[d]["kept"] for d in passing if labels[d] == 0)


def test_pipeline_matches_plain_version(spark, connection):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    trees = quality.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = connection.execute("SELECT doc_id, text, source FROM documents").fetchall()
    kept = []
    for doc_id, text, source in rows:
        n, _, _, _, repeated = brute.base_counts(text)
        counts = dict(zip(quality.COUNTS, ([x] for x in quality.text_counts(text)), strict=True))
        if n >= 10 and 100 * repeated <= 20 * n and brute.score(trees, quality.features(counts)[0]) >= trees.cut:
            kept.append((doc_id, text, source))
    prints = {d: brute.fingerprint(t) for d, t, _ in kept}
    of = brute.classes(set(prints.values()), 4)
    first = {}
    for doc_id in sorted(prints):
        first.setdefault(of[prints[doc_id]], doc_id)
    kept = [r for r in kept if r[0] in first.values()]
    items = connection.execute("SELECT item_id, text FROM benchmark").fetchall()
    clean = [r for r in kept if not brute.hits(r[1], items)[1]]
    assert 0 < len(clean) < len(kept) < len(rows)
    times = brute.copies(clean)
    mixed = [(d, t) for (d, t, _), n in zip(clean, times, strict=True) for _ in range(n)]
    found = [tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect()]
    assert sorted(found) == sorted(brute.token_rows(mixed))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF_DIR), "stage-test")
        assert docs.columns == columns, name
        assert docs.count()


def test_trees_are_monotonic_and_hold_on_unseen_documents():
    generator = np.random.default_rng(5)
    x = generator.random((3000, 4))
    good = (x[:, 0] * 2 - x[:, 1] + 0.2 * generator.standard_normal(3000) < 0.8).astype(float)
    trees = quality.grow(x[:2000], good[:2000], (-1, 1, 0, -1))
    assert ((trees.score(x[2000:]) >= 0) == good[2000:]).mean() > 0.85
    base = np.repeat(x[:200], 50, axis=0)
    for feature, direction in ((0, -1), (1, 1), (3, -1)):
        moved = base.copy()
        moved[:, feature] = np.tile(np.linspace(0, 1, 50), 200)
        steps = np.diff(trees.score(moved).reshape(200, 50), axis=1)
        assert (steps * direction >= -1e-12).all()
    assert np.allclose(trees.score(x[:50]), [brute.score(trees, row) for row in x[:50]])


def test_quality_without_labels_keeps_what_passes_the_base_rules(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "x"), (2, None, "y"), (None, "", None)], "doc_id long, text string, verdict string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]
    assert quality.quality_table(docs.limit(0), labels).collect() == []
