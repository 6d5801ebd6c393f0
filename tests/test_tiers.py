"""Refresh tiers as a stream: final slots once, late rows apart, both together as the batch."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from quizgrove.operators import learning
from quizgrove.streaming import tiers

START = dt.datetime(2024, 3, 1)
SCHEMA = "ts timestamp, value double"


def run(spark, folder, batches, every, delay, **options):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/feed")
        tiers.start(tiers.tier_stream(stream, every, delay, **options), folder).awaitTermination()


def shown(rows):
    return sorted((r["slot_start"], r["n"], None if r["mean_value"] is None else round(r["mean_value"], 6)) for r in rows.collect())


def at(minutes, value=1.0):
    return START + dt.timedelta(minutes=minutes), value


def test_slots_close_after_the_delay_and_late_rows_are_kept(spark, tmp_path):
    folder = str(tmp_path)
    run(spark, folder, [[at(1, 2.0), at(3, None), at(7)], [at(4, 4.0), at(14)]], "5 minutes", "10 minutes", shares=2)
    assert shown(tiers.final_slots(spark, folder)) == []  # the newest event is less than the delay after the first slot's end
    run(spark, folder, [[at(16), (None, 5.0)]], "5 minutes", "10 minutes", shares=2)
    assert shown(tiers.final_slots(spark, folder)) == [(START, 3, 3.0)]
    run(spark, folder, [[at(2, 9.0), at(8, 3.0), at(2, 9.0)]], "5 minutes", "10 minutes", shares=2)
    late = tiers.emitted(spark, folder, tiers.LATE)
    assert [(r["ts"], r["total"]) for r in late.collect()] == [at(2, 9.0)] * 2
    assert shown(tiers.final_slots(spark, folder)) == [(START, 3, 3.0)]
    assert shown(tiers.refreshed(spark, folder)) == [(START, 5, 6.0)]


def test_shuffled_files_give_the_batch_figures(spark, tmp_path):
    generator, folder = random.Random(6), str(tmp_path)
    rows = [at(generator.uniform(0, 600), generator.choice([None, 1.5, 2.0, 7.25])) for _ in range(400)] + [at(30, 1.0)] * 100
    generator.shuffle(rows)
    beat = [at(100_000, None)]
    run(spark, folder, [rows[:150], rows[150:300], rows[300:], beat], "15 minutes", "30 minutes", shares=4)
    events = spark.createDataFrame(rows, SCHEMA)
    wanted = learning.refresh_tier(events, "15 minutes", {"n": F.count("*"), "mean_value": F.round(F.avg("value"), 6)})
    assert shown(tiers.refreshed(spark, folder)) == shown(wanted)
    finals = tiers.emitted(spark, folder, tiers.FINAL)
    assert tiers.emitted(spark, folder, tiers.LATE).count() > 0
    assert finals.groupBy("slot_start").count().filter("count > 4").isEmpty()
