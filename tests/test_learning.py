from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizgrove.operators import learning, ranking


@pytest.mark.parametrize("ranges", [2, 16, 256])
def test_positions_and_percentiles_with_a_hot_group(spark, ranges):
    rng = random.Random(2)
    rows = [("hot", float(rng.choice([7, rng.randrange(200)]))) for _ in range(900)] + [("cold", 1.0), ("cold", 3.0)]
    rows += [(None, float(rng.randrange(9))) for _ in range(40)]
    frame = spark.createDataFrame(rows, "g string, x double")
    found = ranking.value_positions(frame, ["g"], "x", ranges=ranges).collect()
    for group in ("hot", "cold", None):
        values = sorted(x for g, x in rows if g == group)
        mine = {r.x: (r.n, r.before, r.total) for r in found if r.g == group}
        assert mine == {x: (values.count(x), sum(v < x for v in values), len(values)) for x in set(values)}
    points = {"a": 0.0, "b": 0.333, "c": 0.9, "d": 1.0}
    got = {r.g: r for r in ranking.percentiles(frame, ["g"], "x", points).collect()}
    for group in got:
        values = [x for g, x in rows if g == group]
        for name, fraction in points.items():
            assert got[group][name] == pytest.approx(np.quantile(values, fraction))
    whole = ranking.percentiles(frame, [], "x", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median([x for _, x in rows]))


def attempts(spark, rows):
    schema = "learner_id long, teacher_id long, question_id long, topic string, day date, correct int, gain double, score double"
    return spark.createDataFrame(rows, "learner_id long, topic string, correct int").selectExpr(
        "learner_id", "learner_id AS teacher_id", "learner_id AS question_id", "topic", "date '2024-01-01' AS day",
        "correct", "0.5D AS gain", "1.0D AS score",
    ).select(*[part.split()[0] for part in schema.split(", ")])


def test_co_occurrence_counts_learners(spark):
    rows = attempts(spark, [(1, "a", 1), (1, "b", 1), (1, "a", 0), (2, "a", 1), (2, "b", 1), (2, "c", 1), (3, "c", 1)])
    got = {(r.topic_a, r.topic_b): r.learners for r in learning.co_occurrence(rows).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


def test_agreement_from_counts_equals_pairs(spark):
    votes = [1, 1, 0, 1, 0]
    rows = spark.createDataFrame([("q", v) for v in votes] + [("single", 1)], "item string, v int")
    got = {r.item: r.agreement for r in learning.rater_agreement(rows, "item", "v").collect()}
    pairs = [(a, b) for i, a in enumerate(votes) for b in votes[i + 1 :]]
    assert got["q"] == pytest.approx(sum(a == b for a, b in pairs) / len(pairs)) and got["single"] is None


def test_quality_without_positives(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0)], "a int, p int")
    row = learning.classifier_quality(rows, "a", "p", []).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, None, None, None)


def test_time_to_clear_needs_a_later_day(spark):
    rows = spark.sql(
        """SELECT * FROM VALUES (date '2024-01-01','a','low',0.9D), (date '2024-01-02','a','high',0.5D),
        (date '2024-01-05','a','low',0.8D), (date '2024-01-03','b','high',0.4D)
        AS t(snapshot_date, student_id, risk_level, attendance_rate)"""
    )
    got = {r.student_id: r.days for r in learning.time_to_clear(rows, "high").collect()}
    assert got == {"a": 3, "b": None}
    effect = {r.student_id: (r.before, r.after) for r in learning.intervention_effect(rows, "high").collect()}
    assert effect == {"a": (0.9, 0.65), "b": (None, 0.4)}


def test_null_groups_are_groups(spark):
    frame = spark.createDataFrame(
        [(None, 1.0), (None, 2.0), (None, 6.0), ("a", 1.0), ("a", 1.0), ("a", 3.0)], "topic string, score double"
    )
    scores = learning.standard_scores(frame, "topic", "score").collect()
    assert sum(r.n for r in scores if r.topic is None) == 3 and sum(r.n for r in scores if r.topic == "a") == 3
    boxes = {r.topic: r for r in learning.box_plot(frame, "topic", "score").collect()}
    assert boxes[None].median == 2.0 and boxes["a"].median == 1.0
    tries = attempts(spark, [(1, None, 1), (1, "t", 0), (2, None, 0), (2, "t", 1)])
    shares = {(r.topic, r.learner_id): r.share for r in learning.contribution(tries).collect()}
    assert shares[None, 1] == 1.0 and shares["t", 2] == 1.0 and len(shares) == 4
    assert {r.teacher_id: r.n for r in learning.value_added(tries).collect()} == {1: 2, 2: 2}
    lifts = learning.association(tries.withColumn("kind", F.lit(None).cast("string")), "kind", "topic").collect()
    assert {r.topic: r.lift for r in lifts} == {None: 1.0, "t": 1.0}


@pytest.mark.parametrize("ranges", [2, 3, 17, 256])
def test_a_value_meets_few_of_the_bounds(spark, ranges):
    bounds = sorted(random.Random(4).choices(range(90), k=ranges - 1))
    rows = spark.range(95).withColumn("bounds", F.lit(bounds).cast("array<bigint>"))
    found = rows.select("id", ranking._bounds_below(F.col("bounds"), F.col("id"), ranges).alias("below")).collect()
    assert {r.id: r.below for r in found} == {x: sum(bound < x for bound in bounds) for x in range(95)}


def test_a_box_plot_reads_the_rows_once(spark):
    rows = [("t", 1.0), ("t", 1.0), ("t", 2.5), ("t", 90.0), ("t", None), ("one", 4.0), (None, 2.0), (None, 3.0), ("none", None)]
    frame = spark.createDataFrame(rows, "topic string, score double")
    boxes = learning.box_plot(frame, "topic", "score")
    assert "ExistingRDD" not in boxes._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in boxes._jdf.queryExecution().optimizedPlan().toString()
    assert boxes.inputFiles()
    found = {r.topic: r for r in boxes.collect()}
    plain = {r.topic: r.v for r in frame.groupBy("topic").agg(F.round(F.stddev("score") / F.avg("score"), 6).alias("v")).collect()}
    assert {topic: row.variation for topic, row in found.items()} == {topic: plain[topic] for topic in ("t", "one", None)}
    assert found["t"].outliers == 1
