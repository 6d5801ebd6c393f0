"""Progress, error budget and states of a load."""

from __future__ import annotations

import json

import pytest

from quizgrove.sources import changes
from quizgrove.streaming import feeds, loads

FEED = "kafka_offset long, topic string, value string"


def change(offset, op="u", ok=True):
    value = json.dumps({"snapshot_date": 19723, "student_id": f"S{offset % 5}", "__op": op, "__ts_ms": offset}) if ok else "{bad"
    return (offset, "srv.db.abc_warning", value)


def load(spark, folder, **options):
    return loads.Load(
        spark, f"{folder}/load", lambda: changes.file_changes(spark, f"{folder}/feed", files_per_batch=1), feeds.upsert_batch(f"{folder}/load/copy", **options)
    )


def add(spark, folder, rows):
    spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{folder}/feed")


def test_progress_adds_up_and_states_are_kept(spark, tmp_path):
    folder = str(tmp_path)
    add(spark, folder, [change(i, "cudrx"[i % 5]) for i in range(10)] + [change(90, ok=False)])
    first = load(spark, folder)
    with pytest.raises(loads.LoadStateError):
        first.pause()
    first.run()
    first.pause("night")
    add(spark, folder, [change(i) for i in range(10, 14)])
    again = load(spark, folder)  # as another session would make it
    assert again.state() == loads.PAUSED
    again.run()
    row = again.totals().first().asDict()
    assert row == {"batches": 2, "good": 14, "bad": 1, "last_offset": 90, "op_c": 2, "op_u": 6, "op_d": 2, "op_r": 2, "op_other": 2}
    again.stop()
    with pytest.raises(loads.LoadStateError):
        load(spark, folder).run()
    with pytest.raises(loads.LoadStateError):
        again.pause()
    history = [(r.state, r.reason) for r in again.history().orderBy("step").collect()]
    assert history == [("running", None), ("paused", "night"), ("running", None), ("stopped", "by hand")]


def test_the_budget_holds_over_the_whole_load(spark, tmp_path):
    folder = str(tmp_path)
    for at in range(3):
        add(spark, folder, [change(at * 10), change(at * 10 + 1, ok=False), change(at * 10 + 2, ok=False)])
    tight = load(spark, folder, max_bad=2, load_budget=5)
    tight.run()
    assert tight.state() == loads.PAUSED and "6 unreadable records in the load" in tight.history().filter("state = 'paused'").first()["reason"]
    assert tight.totals().first()["batches"] == 2
    assert spark.read.parquet(f"{folder}/load/copy/bad/batch_id=2").count() == 2  # put aside before the batch was refused
    wide = load(spark, folder, load_budget=6)
    wide.run()
    assert wide.state() == loads.RUNNING and wide.totals().first()["bad"] == 6


def test_a_running_load_can_be_paused(spark, tmp_path):
    folder = str(tmp_path)
    add(spark, folder, [change(1)])
    running = load(spark, folder)
    running.run(seconds=1)
    running.query.processAllAvailable()
    with pytest.raises(loads.LoadStateError):
        running.run()
    assert feeds.progress(running.query)["active"] is True
    running.pause()
    assert running.query.isActive is False and running.state() == loads.PAUSED
    assert running.totals().first()["good"] == 1
    assert feeds.load_totals(feeds.load_progress(spark, f"{folder}/none")).first()["good"] == 0
