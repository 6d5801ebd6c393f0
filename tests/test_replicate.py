from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quizgrove.operators import replicate
from quizgrove.sources import changes

ROW = "snapshot_date date, student_id string, rate double"
KEYS = ["snapshot_date", "student_id"]


def day(n):
    return dt.date(2024, 1, n)


def test_incremental_sees_new_keys_only(spark):
    target = spark.createDataFrame([(day(1), "a", 1.0), (day(5), "a", 1.0)], ROW)
    source = spark.createDataFrame(
        [(day(1), "late", 2.0), (day(5), "a", 9.0), (day(5), "b", 2.0), (day(6), "a", 2.0)], ROW
    )
    rows = {(r.snapshot_date, r.student_id) for r in replicate.incremental_rows(source, target, "snapshot_date", KEYS).collect()}
    assert rows == {(day(5), "b"), (day(6), "a")}


def test_incremental_into_an_empty_target(spark):
    target = spark.createDataFrame([], ROW)
    source = spark.createDataFrame([(day(1), "a", 1.0), (day(4), "b", 1.0)], ROW)
    floor = F.lit("2024-01-02").cast("date")
    rows = replicate.incremental_rows(source, target, "snapshot_date", KEYS, floor).collect()
    assert [r.student_id for r in rows] == ["b"]
    assert replicate.incremental_rows(source, target, "snapshot_date", KEYS).isEmpty()


def test_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    assert replicate.missing_rows(rows, rows, ["k"]).count() == 1
    assert replicate.missing_rows(rows, rows, ["k"], null_safe=True).isEmpty()


def test_incremental_copies_add_up_to_a_full_copy(spark):
    source = spark.createDataFrame([(day(n), s, float(n)) for n in range(1, 9) for s in "abc"], ROW)
    target = spark.createDataFrame([], ROW)
    floor = F.lit("2024-01-01").cast("date")
    for last in (3, 3, 8):
        seen = source.filter(F.col("snapshot_date") <= day(last))
        fresh = replicate.incremental_rows(seen, target, "snapshot_date", KEYS, floor)
        target = spark.createDataFrame(replicate.insert_skip(target, fresh, KEYS).collect(), ROW)
    assert sorted(target.collect()) == sorted(source.collect())


def test_reconcile_with_an_empty_side(spark):
    source = spark.createDataFrame([(day(3), "a", 1.0)], ROW)
    row = replicate.reconcile(source, spark.createDataFrame([], ROW), "snapshot_date").first()
    assert (row.same_count, row.same_latest, row.days_behind) == (False, False, 0)


def test_gap_sign(spark):
    few, many = spark.range(1), spark.range(3000)
    assert not replicate.gap(few, many).first().healthy
    assert replicate.gap(few, many, signed=True).first().healthy


def test_verify_and_changed_rows(spark):
    left = spark.createDataFrame([(1, "x", None), (2, "y", 1.0), (3, "z", 1.0)], "id int, name string, rate double")
    right = spark.createDataFrame([(1, "x", None), (2, "Y", 2.0), (4, "z", 1.0)], "id int, name string, rate double")
    checks = {r.check_name: r.n_rows for r in replicate.verify(left, right, ["id"]).collect()}
    assert checks == {"missing": 1, "extra": 1, "changed_name": 1, "changed_rate": 1}
    cells = {(r.id, r.column_name): (r.source_value, r.target_value) for r in replicate.changed_rows(left, right, ["id"]).collect()}
    assert cells == {(2, "name"): ("y", "Y"), (2, "rate"): ("1.0", "2.0")}


def test_latest_by_event_time_then_offset(spark):
    rows = spark.createDataFrame([("a", 5, 1, "u"), ("a", 5, 2, "d"), ("a", 4, 9, "c")], "k string, ts_ms long, kafka_offset long, op string")
    last = replicate.latest_per_key(rows, ["k"])
    assert last.first().op == "d" and replicate.live_rows(last).isEmpty()


def test_wire_types_and_bad_records(spark):
    feed = spark.createDataFrame(
        [
            (1, "s.d.t", '{"snapshot_date":19723,"student_id":"S1","attendance_rate":"0.1250","op":"c","ts_ms":7}'),
            (2, "s.d.t", '{"snapshot_date":"2024-01-02","student_id":"S2","__op":"u","__deleted":"true"}'),
            (3, "s.d.t", "{bad"),
            (4, "s.d.t", None),
        ],
        "kafka_offset long, topic string, value string",
    )
    rows = {r.kafka_offset: r for r in changes.parsed(feed).collect()}
    assert rows[1].snapshot_date == day(1) and str(rows[1].attendance_rate) == "0.1250" and rows[1].op == "c"
    assert rows[2].snapshot_date == day(2) and rows[2].op == "d"
    assert not rows[3].ok and not rows[4].ok
    assert changes.routed(feed).first().table == "t"
    parsed = changes.parsed(feed)
    changes.check_bad(parsed, 2)
    with pytest.raises(ValueError):
        changes.check_bad(parsed, 1)


def test_envelopes(spark):
    feed = spark.createDataFrame(
        [
            (1, '{"before":null,"after":{"id":1},"op":"c","ts_ms":5,"source":{"db":"d","table":"t"}}'),
            (2, '{"before":{"id":1},"after":null,"op":"d","ts_ms":6,"source":{"db":"d","table":"t"}}'),
            (3, None),
        ],
        "kafka_offset long, value string",
    )
    rows = changes.unwrapped(feed, "id int").orderBy("kafka_offset").collect()
    assert [(r.id, r.op, r.deleted, r.source_table) for r in rows] == [(1, "c", False, "t"), (1, "d", True, "t")]


def test_kafka_options():
    options = changes.kafka_options("host:9092", "s.d.t")
    assert options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "100000"


def test_only_buckets_that_differ_meet(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 == 0, "x").alias("b"))
    other = rows.filter("id <> 17").withColumn("a", F.when(F.col("id") == 40, 99).otherwise(F.col("a")).cast("int"))
    other = other.unionByName(spark.createDataFrame([(9000, 1, None)], "id long, a int, b string"))
    source, target = replicate.unequal_parts(rows, other, ["id"])
    assert source.count() <= 20 and target.count() <= 20
    assert {17, 40} <= {r.id for r in source.collect()} and {40, 9000} <= {r.id for r in target.collect()}
    counts = {r.check_name: r.n_rows for r in replicate.verify(rows, other, ["id"]).collect()}
    assert counts == {"missing": 1, "extra": 1, "changed_a": 1, "changed_b": 0}
    cells = [tuple(r) for r in replicate.changed_rows(rows, other, ["id"]).collect()]
    assert cells == [(40, "a", "5", "99")]
    same = replicate.unequal_parts(rows, rows.repartition(3), ["id"])
    assert same[0].isEmpty() and same[1].isEmpty()
    assert {r.n_rows for r in replicate.verify(rows, rows, ["id"]).collect()} == {0}


def test_digests_tell_null_from_text_and_swapped_columns(spark):
    left = spark.createDataFrame([(1, None, "a"), (2, "", "x"), (3, "b", "c"), (None, "n", "n")], "id long, p string, q string")
    right = spark.createDataFrame([(1, "a", None), (2, None, "x"), (3, "b", "c"), (None, "n", "n")], "id long, p string, q string")
    counts = {r.check_name: r.n_rows for r in replicate.verify(left, right, ["id"]).collect()}
    assert counts == {"missing": 1, "extra": 1, "changed_p": 2, "changed_q": 1}  # NULL keys match nothing


def test_latency_from_stored_sketches(spark):
    rows = spark.range(20000).select((F.lit(10**12) + F.col("id") * F.col("id") % 700001).alias("ts_ms"), (F.col("id") % 9).alias("batch"))
    sketches = rows.groupBy("batch").agg(replicate.latency_sketch(F.col("ts_ms")).alias("ts_sketch"))
    as_of = F.timestamp_millis(F.lit(10**12 + 10**6))
    for fraction in (0.5, 0.99):
        found = replicate.sketched_latency(sketches, as_of, fraction).first()
        below = rows.filter(F.lit(10**12 + 10**6) - F.col("ts_ms") <= found[0]).count()
        assert found.n_rows == 20000 and abs(below / 20000 - fraction) < 0.012
    nothing = spark.createDataFrame([(None,)], "ts_sketch binary")
    assert replicate.sketched_latency(nothing, as_of).first()[0] is None
