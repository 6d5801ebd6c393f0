from __future__ import annotations

import json
import random

import pytest

from quizgrove.operators.replicate import latest_per_key
from quizgrove.session import finished_numbers
from quizgrove.sources import changes
from quizgrove.streaming import feeds

FEED = "kafka_offset long, topic string, value string"


def change(offset, student, op, ts, count):
    value = {"snapshot_date": 19723, "student_id": student, "violation_cnt": count, "__op": op, "__ts_ms": ts}
    return (offset, "srv.db.abc_warning", json.dumps(value))


def events(n=60):
    rng = random.Random(3)
    return [change(i, f"S{rng.randrange(6)}", rng.choice("cud"), rng.randrange(20), i) for i in range(n)]


def run(spark, folder, feed, **options):
    stream = changes.file_changes(spark, feed, files_per_batch=1)
    query = feeds.start(stream, feeds.upsert_batch(f"{folder}/copy", **options), f"{folder}/checkpoint")
    query.awaitTermination()
    return query


def state(spark, folder):
    return sorted((r.student_id, r.op, r.violation_cnt) for r in feeds.current(spark, f"{folder}/copy").collect())


def expected(spark, rows):
    frame = changes.good(changes.parsed(spark.createDataFrame(rows, FEED)))
    return sorted((r.student_id, r.op, r.violation_cnt) for r in latest_per_key(frame.drop("ok"), feeds.KEYS).collect())


def test_any_order_gives_the_same_copy_and_compaction_keeps_it(spark, tmp_path):
    rows = events()
    for name, order in (("sorted", rows), ("shuffled", random.Random(1).sample(rows, len(rows)))):
        folder, feed = f"{tmp_path}/{name}", f"{tmp_path}/{name}-feed"
        for at in range(0, len(order), 20):
            spark.createDataFrame(order[at : at + 20], FEED).coalesce(1).write.mode("append").parquet(feed)
        query = run(spark, folder, feed)
        assert feeds.progress(query)["active"] is False
        assert state(spark, folder) == expected(spark, rows)
        feeds.compact(spark, f"{folder}/copy", upto=1)
        assert state(spark, folder) == expected(spark, rows)


def test_folded_batches_are_removed_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows, folder = events(), f"{tmp_path}/folded"
    work = feeds.upsert_batch(f"{folder}/copy", compact_every=2)
    parts = [spark.createDataFrame(rows[at : at + 10], FEED) for at in range(0, 60, 10)]
    for number, part in enumerate(parts):
        work(part, number)
        assert state(spark, folder) == expected(spark, rows[: 10 * number + 10])
    assert finished_numbers(spark, f"{folder}/copy/rows/batch_id=") == [4, 5]
    assert finished_numbers(spark, f"{folder}/copy/base/upto=") == [3, 5]
    work(parts[5], 5)
    assert state(spark, folder) == expected(spark, rows)
    feeds.compact(spark, f"{folder}/copy", upto=2)
    assert state(spark, folder) == expected(spark, rows)


def test_resume_and_repeated_batch(spark, tmp_path):
    rows, folder, feed = events(), str(tmp_path / "x"), str(tmp_path / "feed")
    spark.createDataFrame(rows[:30], FEED).coalesce(1).write.mode("append").parquet(feed)
    run(spark, folder, feed)
    spark.createDataFrame(rows[30:], FEED).coalesce(1).write.mode("append").parquet(feed)
    run(spark, folder, feed)
    assert state(spark, folder) == expected(spark, rows)
    feeds.upsert_batch(f"{folder}/copy")(spark.createDataFrame(rows[30:], FEED), 1)
    assert state(spark, folder) == expected(spark, rows)


def test_insert_update_delete_are_visible(spark, tmp_path):
    folder, feed = str(tmp_path / "x"), str(tmp_path / "feed")
    for step, op in enumerate("cud"):
        spark.createDataFrame([change(step, "S1", op, step, step)], FEED).write.mode("append").parquet(feed)
        run(spark, folder, feed)
        assert state(spark, folder) == [("S1", op, step)]


def test_bad_records_go_aside_or_stop_the_batch(spark, tmp_path):
    rows = [*events(5), (90, "srv.db.abc_warning", "{bad"), (91, "srv.db.abc_warning", "{bad")]
    frame = spark.createDataFrame(rows, FEED)
    root = str(tmp_path / "copy")
    with pytest.raises(ValueError):
        feeds.upsert_batch(root, max_bad=1)(frame, 0)
    feeds.upsert_batch(root, max_bad=2)(frame, 0)
    assert spark.read.parquet(f"{root}/bad/batch_id=0").count() == 2


def test_snapshot_rows_yield_to_changes(spark):
    schema = "snapshot_date date, student_id string, violation_cnt int"
    snapshot = spark.sql("SELECT date '2024-01-01', 'S0', 1 UNION ALL SELECT date '2024-01-01', 'S9', 2").toDF(
        *[part.split()[0] for part in schema.split(", ")]
    )
    rows = changes.good(changes.parsed(spark.createDataFrame([change(1, "S0", "u", 3, 7)], FEED)))
    merged = {r.student_id: (r.op, r.violation_cnt) for r in feeds.with_snapshot(snapshot, rows).collect()}
    assert merged == {"S0": ("u", 7), "S9": ("r", 2)}
