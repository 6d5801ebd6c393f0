"""The polling copy in date folders, and redelivered change records."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from quizgrove.session import finished_numbers
from quizgrove.sources import changes
from quizgrove.streaming import feeds, polling

SCHEMA = "id long, day date, price double"
DAY = dt.date(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if d is None else DAY + dt.timedelta(days=d), float(i)) for i, d in rows], SCHEMA).repartition(3)


def target(tmp_path, spark, grain="day"):
    return polling.Target(str(tmp_path / "copy"), frame(spark, []).schema, "day", ("id", "day"), grain)


def state(spark, copy, **options):
    return sorted((r.id, r.day and (r.day - DAY).days) for r in polling.copied(spark, copy, **options).collect())


def test_polls_copy_what_is_new_since_the_mark(spark, tmp_path):
    for grain in ("day", "month"):
        copy = target(tmp_path / grain, spark, grain)
        first = [(1, 0), (2, 5), (3, None), (2, 5)]
        polling.begin(frame(spark, first), copy)
        assert polling.mark(spark, copy) == DAY + dt.timedelta(days=5)
        work = polling.poll(copy, fold_every=None)
        work(frame(spark, [(1, 0), (2, 5), (4, 5), (4, 5), (5, 2), (6, 40), (7, None)]), 0)
        held = [*first, (4, 5), (6, 40)]  # 5 is older than the mark, 7 has no date
        assert state(spark, copy) == sorted(held, key=lambda r: (r[0], r[1] or -1))
        assert polling.mark(spark, copy) == DAY + dt.timedelta(days=40)
        work(frame(spark, []), 1)
        assert polling.mark(spark, copy) == DAY + dt.timedelta(days=40)
        work(frame(spark, [(8, 5), (9, 41)]), 1)  # a poll that finished is not repeated
        work(frame(spark, [(8, 5), (9, 41)]), 2)
        assert (9, 41) in state(spark, copy) and (8, 5) not in state(spark, copy)
        assert state(spark, copy, floor=DAY + dt.timedelta(days=40)) == [(6, 40), (9, 41)]


def test_a_poll_reads_folders_from_the_mark_on(spark, tmp_path):
    copy = target(tmp_path, spark)
    polling.begin(frame(spark, [(i, i) for i in range(30)]), copy)
    floor = polling.mark(spark, copy)
    assert [folder.part for folder in polling.folders(spark, copy, floor)] == [floor]
    rows = polling.new_rows(frame(spark, [(29, 29), (30, 29), (31, 31)]), copy, floor)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "(part" in plan.split("PartitionFilters")[1].split("]")[0]
    files = polling.copied(spark, copy, floor).inputFiles()
    assert files and all(f"part={floor}/" in file for file in files)
    assert sorted(r.id for r in rows.collect()) == [30, 31]


def test_what_a_failed_poll_left_is_not_seen(spark, tmp_path):
    copy = target(tmp_path, spark)
    polling.begin(frame(spark, [(1, 0)]), copy)
    polling._write(frame(spark, [(2, 0), (3, 9)]), copy, "poll-1")  # its record was never written
    assert state(spark, copy) == [(1, 0)]
    polling.poll(copy)(frame(spark, [(2, 0)]), 0)
    assert state(spark, copy) == [(1, 0), (2, 0)] and polling.mark(spark, copy) == DAY


def test_folding_keeps_the_rows_and_removes_folders(spark, tmp_path):
    copy = target(tmp_path, spark)
    polling.begin(frame(spark, [(0, 0), (1, 1), (50, None)]), copy)
    work, held = polling.poll(copy, fold_every=2), [(0, 0), (1, 1), (50, None)]
    for number in range(7):
        work(frame(spark, [(100 + number, 1), (200 + number, 2)]), number)
        held += [(100 + number, 1)] if number == 0 else []
        held += [(200 + number, 2)]
        assert state(spark, copy) == sorted(held, key=lambda r: (r[0], r[1] or -1))
        assert polling.mark(spark, copy) == DAY + dt.timedelta(days=2)
    assert finished_numbers(spark, f"{copy.root}/log_base/upto=") == [4, 6]
    assert finished_numbers(spark, f"{copy.root}/log/batch_id=") == [5, 6, 7]
    assert sorted(os.listdir(f"{copy.root}/data/part=2024-01-03")) == sorted(["folder=poll-5", "folder=poll-6", "folder=poll-7", "folder=upto-4", "folder=upto-6"])
    assert len(polling.folders(spark, copy)) == 5  # a folder a date, the newest poll's beside it
    polling.fold(spark, copy, 6)
    assert state(spark, copy) == sorted(held, key=lambda r: (r[0], r[1] or -1))


def test_an_empty_copy_starts_from_the_floor(spark, tmp_path):
    copy = target(tmp_path, spark)
    polling.begin(frame(spark, []), copy)
    assert polling.mark(spark, copy) is None and state(spark, copy) == []
    polling.poll(copy, empty_floor=F.lit("2024-01-03"))(frame(spark, [(1, 1), (2, 2), (3, 8)]), 0)
    assert state(spark, copy) == [(2, 2), (3, 8)]


def test_records_delivered_twice_count_once(spark, tmp_path):
    rows = [(i, "srv.db.abc_warning", f'{{"snapshot_date": 19723, "student_id": "S{i % 7}", "__op": "u", "__ts_ms": {i}}}') for i in range(60)]
    again = [row for row in rows if row[0] % 3 == 0]
    feed, counts = str(tmp_path / "feed"), []
    for part in (rows[:30], again[:15], rows[30:] + rows[:5], again):
        spark.createDataFrame(part, "kafka_offset long, topic string, value string").coalesce(1).write.mode("append").parquet(feed)
    work = feeds.upsert_batch(str(tmp_path / "copy"))

    def counted(batch, batch_id):
        counts.append(batch.count())
        work(batch, batch_id)

    for _ in range(2):  # a second start resumes with the same state
        stream = changes.delivered_once(changes.file_changes(spark, feed, files_per_batch=1))
        feeds.start(stream, counted, str(tmp_path / "checkpoint")).awaitTermination()
        spark.createDataFrame(rows[40:] + [(99, None, None)], "kafka_offset long, topic string, value string").coalesce(1).write.mode("append").parquet(feed)
    assert sum(counts) == 61
    assert sorted(r.student_id for r in feeds.current(spark, str(tmp_path / "copy")).collect()) == [f"S{i}" for i in range(7)]
