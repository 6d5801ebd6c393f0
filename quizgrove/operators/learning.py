"""Learning metrics over attempts.

``attempts``: learner_id, teacher_id, question_id, topic, question_type, difficulty, day, correct (0/1),
self_rating (0/1), score, gain. Metrics that follow a learner over time work on one row per learner,
topic and day, so that no window holds more rows than there are days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizgrove.operators.joins import null_safe_join
from quizgrove.operators.ranking import percentiles_of, value_positions
from quizgrove.session import saved

# Fixed values of the metrics.
SPACING_DAYS = (2, 14)
MASTERY_LEVELS = ((0.8, "mastered"), (0.5, "partial"))
TAIL_SHARE = 0.27
ANOMALY_SCORE = 3.0


def _mean(value: Column | str, digits: int = 9) -> Column:
    return F.round(F.avg(value), digits)


def metacognition(attempts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Agreement of self-rating and result, and its bias (L1)."""
    return attempts.groupBy(*group).agg(
        _mean((F.col("self_rating") == F.col("correct")).cast("int")).alias("accuracy"),
        _mean(F.col("self_rating") - F.col("correct")).alias("bias"),
        F.count("*").alias("n"),
    )


def study_days(attempts: DataFrame) -> DataFrame:
    """One row per learner, topic and day with the gap to the day studied before."""
    daily = attempts.groupBy("learner_id", "topic", "day").agg(
        F.avg("gain").alias("gain"), F.avg("correct").alias("correct")
    )
    earlier = F.lag("day").over(Window.partitionBy("learner_id", "topic").orderBy("day"))
    return daily.withColumn("gap", F.datediff("day", earlier))


def interval_effect(attempts: DataFrame, longest: int = 14) -> DataFrame:
    """Mean gain by days since the last study of the topic (L2)."""
    return (
        study_days(attempts).filter(F.col("gap").between(1, longest))
        .groupBy("gap", "topic").agg(_mean("gain").alias("mean_gain"), F.count("*").alias("n"))
    )


def coverage_gain(attempts: DataFrame) -> DataFrame:
    """Share of topics a learner touched, against mean gain (L3)."""
    topics = attempts.select(F.count_distinct("topic").alias("n")).select("n").scalar()
    return attempts.groupBy("learner_id").agg(
        F.count_distinct("topic").alias("topics"), _mean("gain").alias("mean_gain"), F.count("*").alias("n")
    ).withColumn("coverage", F.round(F.col("topics") / topics, 6))


def mastery_funnel(attempts: DataFrame) -> DataFrame:
    """Learners per stage and the share kept from the stage before (L4)."""
    learner = attempts.groupBy("learner_id").agg(F.sum("correct").alias("right"), F.avg("correct").alias("rate"))
    stages = {
        "1_tried": F.lit(True),
        "2_solved": F.col("right") >= 1,
        "3_halfway": (F.col("right") >= 1) & (F.col("rate") >= 0.5),
        "4_mastered": (F.col("right") >= 1) & (F.col("rate") >= 0.8),
    }
    counts = learner.agg(*[F.count_if(met).alias(name) for name, met in stages.items()])
    long = counts.unpivot([], list(stages), "stage", "learners")
    before = F.lag("learners").over(Window.orderBy("stage"))  # four rows
    return long.withColumn("conversion", F.round(F.col("learners") / before, 6))


def quadrants(attempts: DataFrame) -> DataFrame:
    """Topics by success and effort, each against the median topic."""
    topics = attempts.groupBy("topic").agg(F.avg("correct").alias("success"), F.avg("score").alias("effort"))
    middle = topics.agg(F.percentile("success", F.lit(0.5)).alias("s"), F.percentile("effort", F.lit(0.5)).alias("e"))
    high = F.col("success") >= middle.select("s").scalar()
    long = F.col("effort") >= middle.select("e").scalar()
    label = F.concat_ws("-", F.when(high, "high").otherwise("low"), F.when(long, "long").otherwise("short"))
    return topics.select(
        "topic", F.round("success", 6).alias("success"), F.round("effort", 4).alias("effort"), label.alias("quadrant")
    )


def gain_waterfall(attempts: DataFrame) -> DataFrame:
    """Gain per topic and the running total in topic order."""
    sums = attempts.groupBy("topic").agg(F.sum("gain").alias("gain"))
    running = F.sum("gain").over(Window.orderBy("topic").rowsBetween(Window.unboundedPreceding, 0))  # one row a topic
    return sums.select("topic", F.round("gain", 4).alias("gain"), F.round(running, 4).alias("running"))


def spacing_compliance(attempts: DataFrame, target: float = 0.8) -> DataFrame:
    """Share of study gaps inside the recommended range by year and topic."""
    gaps = study_days(attempts).filter(F.col("gap").isNotNull())
    inside = F.col("gap").between(*SPACING_DAYS).cast("int")
    return gaps.groupBy(F.year("day").alias("year"), "topic").agg(
        F.round(F.avg(inside), 9).alias("compliance"), (F.avg(inside) >= target).alias("met"), F.count("*").alias("n")
    )


def difficulty_grid(attempts: DataFrame, step: int = 10) -> DataFrame:
    """Success by difficulty band and topic."""
    band = F.floor(F.col("difficulty") / step).alias("band")
    return attempts.groupBy(band, "topic").agg(_mean("correct").alias("success"), F.count("*").alias("n"))


def feedback_matrix(attempts: DataFrame) -> DataFrame:
    """Mean gain by question type, one column per kind of feedback."""
    return attempts.groupBy("question_type").pivot("self_rating", [0, 1]).agg(_mean("gain")).withColumnsRenamed(
        {"0": "without_feedback", "1": "with_feedback"}
    )


def error_tree(attempts: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Wrong answers on every level of a hierarchy."""
    return attempts.filter("correct = 0").rollup(*levels).agg(F.count("*").alias("errors"))


def association(attempts: DataFrame, left: str, right: str) -> DataFrame:
    """Joint counts of two attributes of wrong answers, with their lift."""
    pairs = attempts.filter("correct = 0").groupBy(left, right).agg(F.count("*").alias("n"))
    by_left = pairs.groupBy(left).agg(F.sum("n").alias("n_left"))
    by_right = pairs.groupBy(right).agg(F.sum("n").alias("n_right"))
    total = pairs.agg(F.sum("n").alias("n")).select("n").scalar()
    lift = F.col("n") * total / (F.col("n_left") * F.col("n_right"))
    return null_safe_join(null_safe_join(pairs, by_left, [left]), by_right, [right]).select(left, right, "n", F.round(lift, 6).alias("lift"))


def classifier_quality(rows: DataFrame, actual: str, predicted: str, group: Sequence[str]) -> DataFrame:
    """Accuracy, precision, recall and F1 of a yes/no prediction."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    counts = rows.groupBy(*group).agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *group,
        F.round(F.try_divide(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"),
        F.round(F.try_divide(tp, tp + fp), 6).alias("precision"),
        F.round(F.try_divide(tp, tp + fn), 6).alias("recall"),
        F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


def error_flow(attempts: DataFrame) -> DataFrame:
    """Moves between states from one study day of a topic to the next."""
    state = F.when(F.col("correct") >= 0.8, "mastered").when(F.col("correct") >= 0.5, "shaky").otherwise("wrong")
    days = study_days(attempts).withColumn("from_state", state)
    following = F.lead("from_state").over(Window.partitionBy("learner_id", "topic").orderBy("day"))
    moves = days.withColumn("to_state", following).filter(F.col("to_state").isNotNull())
    return moves.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def strategy_comparison(attempts: DataFrame, strategy: str) -> DataFrame:
    """Outcome averages per strategy."""
    return attempts.groupBy(strategy).agg(
        _mean("correct").alias("success"), _mean("gain").alias("mean_gain"), F.count("*").alias("n")
    )


def mastery_timeline(attempts: DataFrame) -> DataFrame:
    """First and last day of each status per topic."""
    status = F.when(F.col("correct") == 1, "right").otherwise("wrong").alias("status")
    return attempts.groupBy("topic", status).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def step_paths(events: DataFrame, standard: Sequence[str]) -> DataFrame:
    """Per learner and day: steps left out, efficiency and similarity to the standard path.

    The steps of a day are a set over the known kinds, so each array is short.
    """
    wanted = F.array(*[F.lit(step) for step in standard])
    days = events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.collect_set("event_type").alias("steps"), F.count("*").alias("n_steps")
    )
    shared = F.size(F.array_intersect("steps", wanted))
    return days.select(
        "user_id",
        "day",
        F.array_join(F.sort_array(F.array_except(wanted, "steps")), ",").alias("left_out"),
        F.round(shared / F.col("n_steps"), 6).alias("efficiency"),
        F.round(shared / F.size(F.array_union("steps", wanted)), 6).alias("similarity"),
    )


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """Rows per value range."""
    return rows.groupBy(F.floor(F.col(value) / width).alias("bucket")).agg(F.count("*").alias("n"))


def standard_scores(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Per group and distinct score: z-score, percent rank and how many rows have it."""
    positions = saved(value_positions(rows, [group], value), "positions")
    # Mean and deviation from the counted values: the rows are not read again.
    weight, x = F.col("n"), F.col(value)
    stats = positions.groupBy(group).agg(
        (F.sum(weight * x) / F.sum(weight)).alias("mean"), F.max("total").alias("rows_in_group")
    )
    spread = (
        null_safe_join(positions, stats, [group]).groupBy(group)
        .agg(F.sqrt(F.sum(weight * (x - F.col("mean")) * (x - F.col("mean"))) / F.max("rows_in_group")).alias("spread"))
    )
    scored = null_safe_join(null_safe_join(positions, stats.select(group, "mean"), [group]), spread, [group])
    return scored.select(
        group,
        value,
        F.col("n"),
        F.round(F.try_divide(x - F.col("mean"), F.col("spread")), 5).alias("z_score"),
        F.round(F.coalesce(F.try_divide(F.col("before"), F.col("total") - 1), F.lit(0.0)), 6).alias("percent_rank"),
    )


def box_plot(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, spread and outliers per group."""
    positions = saved(value_positions(rows, [group], value), "positions")
    quarters = percentiles_of(positions, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    weight, x = F.col("n"), F.col(value).cast("double")
    moments = positions.groupBy(group).agg((F.sum(weight * x) / F.sum(weight)).alias("mean"))
    # Groups are few; the join only adds four numbers to a counted value.
    few = null_safe_join(quarters, moments, [group])
    counts = null_safe_join(positions.select(group, value, "n"), few, [group])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    outside = (F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)
    squares = F.sum(weight * (x - F.col("mean")) * (x - F.col("mean")))
    spread = counts.groupBy(group).agg(
        F.coalesce(F.sum(F.when(outside, weight)), F.lit(0)).alias("outliers"),
        F.round(F.sqrt(F.try_divide(squares, F.sum(weight) - 1)) / F.max("mean"), 6).alias("variation"),
    )
    rounded = [F.round(name, 4).alias(name) for name in ("q1", "median", "q3")]
    return null_safe_join(quarters.select(group, *rounded), spread, [group])


def rank_changes(attempts: DataFrame) -> DataFrame:
    """Yearly rank of each learner's points, and the change to the year before."""
    points = attempts.groupBy("learner_id", F.year("day").alias("year")).agg(F.sum("correct").alias("points"))
    positions = value_positions(points.withColumn("lost", -F.col("points")), ["year"], "lost")
    ranks = positions.select("year", (-F.col("lost")).alias("points"), (F.col("before") + 1).alias("place"))
    ranked = null_safe_join(points, ranks, ["year", "points"])
    before = F.lag("place").over(Window.partitionBy("learner_id").orderBy("year"))
    return ranked.withColumn("change", before - F.col("place")).select("learner_id", "year", "points", "place", "change")


def value_added(attempts: DataFrame) -> DataFrame:
    """Teacher effect: mean difference to the topic's mean, with its standard error."""
    # Sums per teacher and topic carry all that is needed; the attempts are shuffled once.
    cells = attempts.groupBy("teacher_id", "topic").agg(
        F.count("*").alias("n"), F.sum("gain").alias("s"), F.sum(F.col("gain") * F.col("gain")).alias("s2")
    )
    topics = cells.groupBy("topic").agg((F.sum("s") / F.sum("n")).alias("m"))
    n, s, s2, m = (F.col(name) for name in ("n", "s", "s2", "m"))
    teachers = null_safe_join(cells, topics, ["topic"]).groupBy("teacher_id").agg(
        F.sum("n").alias("n"),
        F.sum(s - n * m).alias("r"),
        F.sum(s2 - 2 * m * s + n * m * m).alias("r2"),
    )
    mean = F.col("r") / F.col("n")
    deviation = F.sqrt(F.greatest(F.try_divide(F.col("r2") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0)))
    return teachers.select(
        "teacher_id", "n", F.round(mean, 8).alias("value_added"), F.round(deviation / F.sqrt("n"), 8).alias("error")
    )


def learning_track(attempts: DataFrame, window: int = 5, limit: float = ANOMALY_SCORE) -> DataFrame:
    """Daily mean score per learner with unusual days marked."""
    daily = attempts.groupBy("learner_id", "day").agg(F.avg("score").alias("score"))
    past = Window.partitionBy("learner_id").orderBy("day").rowsBetween(-window, -1)
    rolled = daily.select(
        "learner_id", "day", "score",
        F.avg("score").over(past).alias("mean"), F.stddev("score").over(past).alias("spread"),
        F.count("score").over(past).alias("n"),
    )
    unusual = F.abs(F.try_divide(F.col("score") - F.col("mean"), F.col("spread"))) > limit
    return rolled.select(
        "learner_id", "day", F.round("score", 4).alias("score"), F.round("mean", 4).alias("mean"),
        (F.coalesce(unusual, F.lit(False)) & (F.col("n") == window)).alias("anomaly"),
    )


def radar(attempts: DataFrame) -> DataFrame:
    """Mean success per topic in the first and in the last year."""
    years = attempts.agg(F.year(F.min("day")).alias("first"), F.year(F.max("day")).alias("last"))
    year = F.year("day")

    def mean_in(which: str) -> Column:
        return F.round(F.avg(F.when(year == years.select(which).scalar(), F.col("correct"))), 9)

    return attempts.groupBy("topic").agg(mean_in("first").alias("begin"), mean_in("last").alias("end"))


def risk_shares(warnings: DataFrame) -> DataFrame:
    """Share of each risk level per day."""
    counts = warnings.groupBy("snapshot_date", "risk_level").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("snapshot_date"))  # a few levels a day
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def time_to_clear(warnings: DataFrame, risky: str) -> DataFrame:
    """Days from a student's first risky day to the first later day without risk."""
    started = warnings.filter(F.col("risk_level") == risky).groupBy("student_id").agg(F.min("snapshot_date").alias("since"))
    later = warnings.filter(F.col("risk_level") != risky).join(started, "student_id")
    cleared = later.filter(F.col("snapshot_date") > F.col("since")).groupBy("student_id").agg(
        F.min("snapshot_date").alias("cleared")
    )
    return started.join(cleared, "student_id", "left").withColumn("days", F.datediff("cleared", "since"))


def intervention_effect(warnings: DataFrame, risky: str) -> DataFrame:
    """Mean attendance before and from a student's first risky day."""
    started = warnings.filter(F.col("risk_level") == risky).groupBy("student_id").agg(F.min("snapshot_date").alias("since"))
    rows = warnings.join(started, "student_id")
    before = F.col("snapshot_date") < F.col("since")
    return rows.groupBy("student_id").agg(
        F.round(F.avg(F.when(before, F.col("attendance_rate"))), 9).alias("before"),
        F.round(F.avg(F.when(~before, F.col("attendance_rate"))), 9).alias("after"),
    )


def item_analysis(attempts: DataFrame, tail: float = TAIL_SHARE) -> DataFrame:
    """Per question: success rate, nominal difficulty, and top minus bottom learners' success."""
    learners = attempts.groupBy("learner_id").agg(F.sum("correct").alias("points"))
    places = value_positions(learners, [], "points").select(
        "points", F.try_divide(F.col("before"), F.col("total") - 1).alias("share")
    )
    graded = learners.join(places, "points").select("learner_id", "share")
    rows = attempts.select("learner_id", "question_id", "difficulty", "correct").join(graded, "learner_id")
    top, bottom = F.col("share") >= 1 - tail, F.col("share") <= tail
    return rows.groupBy("question_id").agg(
        _mean("correct").alias("success"),
        F.max("difficulty").alias("nominal"),
        F.round(F.avg(F.when(top, F.col("correct"))) - F.avg(F.when(bottom, F.col("correct"))), 6).alias("discrimination"),
    )


def coverage_tree(attempts: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Attempts and distinct questions on every level of a hierarchy."""
    cells = attempts.groupBy(*levels, "question_id").agg(F.count("*").alias("n"))
    return cells.rollup(*levels).agg(F.sum("n").alias("n"), F.count_distinct("question_id").alias("questions"))


def co_occurrence(attempts: DataFrame) -> DataFrame:
    """How many learners met both topics (L23). Learners with the same set of topics count together."""
    sets = attempts.groupBy("learner_id").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    patterns = sets.groupBy("topics").agg(F.count("*").alias("n"))
    left = patterns.select("topics", "n", F.posexplode("topics").alias("at", "topic_a"))
    pairs = left.select("topic_a", F.explode(F.slice("topics", F.col("at") + 2, F.size("topics"))).alias("topic_b"), "n")
    return pairs.groupBy("topic_a", "topic_b").agg(F.sum("n").alias("learners"))


def review_degrees(edges: DataFrame) -> DataFrame:
    """Reviews given and received per person (L24). ``edges``: reviewer, reviewed."""
    given = edges.groupBy(F.col("reviewer").alias("person")).agg(F.count("*").alias("given"))
    received = edges.groupBy(F.col("reviewed").alias("person")).agg(F.count("*").alias("received"))
    return given.join(received, "person", "full").fillna(0, ["given", "received"])


def rater_agreement(rows: DataFrame, item: str, verdict: str) -> DataFrame:
    """Share of rater pairs per item with the same yes/no verdict, from counts instead of pairs."""
    counts = rows.groupBy(item).agg(F.count("*").alias("n"), F.sum(verdict).alias("yes"))
    n, yes = F.col("n"), F.col("yes")
    same = yes * (yes - 1) + (n - yes) * (n - yes - 1)
    return counts.select(item, "n", F.round(F.try_divide(same, n * (n - 1)), 6).alias("agreement"))


def contribution(attempts: DataFrame) -> DataFrame:
    """Share of each learner in the points of a topic."""
    cells = attempts.groupBy("topic", "learner_id").agg(F.sum("correct").alias("points"))
    totals = cells.groupBy("topic").agg(F.sum("points").alias("all_points"))
    return null_safe_join(cells, totals, ["topic"]).select(
        "topic", "learner_id", "points", F.round(F.try_divide("points", "all_points"), 8).alias("share")
    )


def mastery_map(attempts: DataFrame) -> DataFrame:
    """Mastery level per learner and topic."""
    rate = F.avg("correct")
    level = F.lit("open")
    for floor, name in reversed(MASTERY_LEVELS):
        level = F.when(rate >= floor, name).otherwise(level)
    return attempts.groupBy("learner_id", "topic").agg(F.round(rate, 9).alias("rate"), level.alias("level"))


def learning_styles(attempts: DataFrame) -> DataFrame:
    """Learners who rate themselves above their results are confident, the others careful."""
    confident = F.avg("self_rating") > F.avg("correct")
    return attempts.groupBy("learner_id").agg(F.when(confident, "confident").otherwise("careful").alias("style"))


def strategy_match(attempts: DataFrame, styles: DataFrame, strategy: str) -> DataFrame:
    """How well each strategy fits each learning style, and which suits it best.

    ``styles``: learner_id, style. ``fit`` is the share of right answers; of equal fits the one with more attempts
    suits, then the lesser name.
    """
    rows = null_safe_join(attempts.select("learner_id", strategy, "correct"), styles, ["learner_id"])
    cells = rows.groupBy("style", strategy).agg(_mean("correct").alias("fit"), F.count("*").alias("n"))
    order = Window.partitionBy("style").orderBy(F.col("fit").desc_nulls_last(), F.col("n").desc(), strategy)
    # a row per style and strategy is left here
    return cells.withColumn("suits", F.row_number().over(order) == 1)


def list_quality(found: DataFrame, external: DataFrame, items: DataFrame) -> DataFrame:
    """Hit rate, share of items ever recommended, and diversity of the lists.

    Diversity is 1 minus the mean similarity inside a list, from the sum of its unit vectors.
    """
    hits = found.join(
        external.select("query_id", F.col("ext_id").alias("item_id")).distinct().withColumn("hit", F.lit(1)),
        ["query_id", "item_id"],
        "left",
    )
    rates = hits.agg(
        F.round(F.count("hit") / F.count("*"), 6).alias("hit_rate"), F.count_distinct("item_id").alias("recommended")
    )
    listed = found.select("query_id", "item_id").join(
        items.select(F.col("question_id").alias("item_id"), "embedding"), "item_id"
    )
    cells = listed.select("query_id", F.posexplode("embedding").alias("at", "x"))
    x = F.col("x").cast("double")
    sums = cells.groupBy("query_id", "at").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count("*").alias("n"))
    lists = sums.groupBy("query_id").agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("cross"), F.max("n").alias("n"))
    similarity = F.try_divide("cross", F.col("n") * (F.col("n") - 1))
    diversity = lists.agg(F.round(1 - F.avg(similarity), 5).alias("diversity"))
    n_items = items.agg(F.count_distinct("question_id").alias("n"))
    return rates.select(
        "hit_rate",
        F.round(F.col("recommended") / n_items.select("n").scalar(), 6).alias("coverage"),
        diversity.select("diversity").scalar().alias("diversity"),
    )


def refresh_tier(events: DataFrame, every: str, measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Counts and means per time slot such as ``5 minutes`` or ``1 day`` (L28); ``streaming.tiers`` keeps them up to date as a stream."""
    measures = measures or {"n": F.count("*"), "mean_value": _mean("value")}
    slots = events.groupBy(F.window("ts", every).alias("slot")).agg(*[c.alias(n) for n, c in measures.items()])
    return slots.select(F.col("slot.start").alias("slot_start"), *measures)
