"""Learning metrics over attempts, events and warnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizgrove.operators import learning, ranking
from quizgrove.operators.similarity import top_k_similar
from quizgrove.plans.fixtures import table, with_views
from quizgrove.plans.recommend import _ranked_sql, _SCORED
from quizgrove.plans.registry import query
from quizgrove.session import new_folder
from quizgrove.streaming import tiers

_A = with_views("f_attempt")
_W = with_views("f_warning")
_DAYS = f"""{_A},
daily AS (SELECT learner_id, topic, day, avg(gain) gain, avg(correct) correct FROM f_attempt GROUP BY ALL),
days AS (SELECT *, day-lag(day) OVER (PARTITION BY learner_id, topic ORDER BY day) gap FROM daily)"""


def _attempts(spark, sf_dir):
    return table(spark, sf_dir, "f_attempt")


def _text(rows, *names):
    return rows.withColumns({name: F.col(name).cast("string") for name in names})


@query(
    "l1_metacognition",
    f"""{_A} SELECT topic, round(avg(CAST(self_rating=correct AS INT)),9) accuracy, round(avg(self_rating-correct),9) bias,
 count(*) n FROM f_attempt GROUP BY topic""",
)
def metacognition(spark, sf_dir):
    return learning.metacognition(_attempts(spark, sf_dir), ["topic"])


@query(
    "l2_interval_effect",
    f"""{_DAYS} SELECT CAST(gap AS INT) gap, topic, round(avg(gain),9) mean_gain, count(*) n FROM days
WHERE gap BETWEEN 1 AND 14 GROUP BY gap, topic""",
)
def interval_effect(spark, sf_dir):
    return learning.interval_effect(_attempts(spark, sf_dir))


@query(
    "l3_coverage_gain",
    f"""{_A} SELECT learner_id, count(DISTINCT topic) topics, round(avg(gain),9) mean_gain, count(*) n,
 round(count(DISTINCT topic)/(SELECT count(DISTINCT topic) FROM f_attempt),6) coverage FROM f_attempt GROUP BY learner_id""",
)
def coverage_gain(spark, sf_dir):
    return learning.coverage_gain(_attempts(spark, sf_dir))


@query(
    "l4_mastery_funnel",
    f"""{_A}, learner AS (SELECT sum(correct) r, avg(correct) q FROM f_attempt GROUP BY learner_id),
stage AS (SELECT '1_tried' stage, count(*) learners FROM learner UNION ALL SELECT '2_solved', count(*) FROM learner WHERE r>=1
 UNION ALL SELECT '3_halfway', count(*) FROM learner WHERE r>=1 AND q>=0.5
 UNION ALL SELECT '4_mastered', count(*) FROM learner WHERE r>=1 AND q>=0.8)
SELECT stage, learners, round(learners/lag(learners) OVER (ORDER BY stage),6) conversion FROM stage""",
)
def mastery_funnel(spark, sf_dir):
    return learning.mastery_funnel(_attempts(spark, sf_dir))


@query(
    "l5_quadrants",
    f"""{_A}, t AS (SELECT topic, avg(correct) s, avg(score) e FROM f_attempt GROUP BY topic),
m AS (SELECT quantile_cont(s,0.5) ms, quantile_cont(e,0.5) me FROM t)
SELECT topic, round(s,6) success, round(e,4) effort,
 concat(CASE WHEN s>=ms THEN 'high' ELSE 'low' END,'-',CASE WHEN e>=me THEN 'long' ELSE 'short' END) quadrant FROM t, m""",
)
def quadrants(spark, sf_dir):
    return learning.quadrants(_attempts(spark, sf_dir))


@query(
    "l6_gain_waterfall",
    f"""{_A}, s AS (SELECT topic, sum(gain) g FROM f_attempt GROUP BY topic)
SELECT topic, round(g,4) gain, round(sum(g) OVER (ORDER BY topic),4) running FROM s""",
)
def gain_waterfall(spark, sf_dir):
    return learning.gain_waterfall(_attempts(spark, sf_dir))


@query(
    "l7_spacing_compliance",
    f"""{_DAYS} SELECT CAST(year(day) AS INT) "year", topic, round(avg(CAST(gap BETWEEN 2 AND 14 AS INT)),9) compliance,
 avg(CAST(gap BETWEEN 2 AND 14 AS INT))>=0.8 met, count(*) n FROM days WHERE gap IS NOT NULL GROUP BY 1, topic""",
)
def spacing_compliance(spark, sf_dir):
    return learning.spacing_compliance(_attempts(spark, sf_dir))


@query(
    "l8_difficulty_grid",
    f"""{_A} SELECT CAST(floor(difficulty/10) AS BIGINT) band, topic, round(avg(correct),9) success, count(*) n
FROM f_attempt GROUP BY 1, topic""",
)
def difficulty_grid(spark, sf_dir):
    return learning.difficulty_grid(_attempts(spark, sf_dir))


@query(
    "l8_feedback_matrix",
    f"""{_A} SELECT question_type, round(avg(gain) FILTER (self_rating=0),9) without_feedback,
 round(avg(gain) FILTER (self_rating=1),9) with_feedback FROM f_attempt GROUP BY question_type""",
)
def feedback_matrix(spark, sf_dir):
    return learning.feedback_matrix(_attempts(spark, sf_dir))


@query(
    "l9_error_tree",
    f"""{_A} SELECT topic, question_type, difficulty, count(*) errors FROM f_attempt WHERE correct=0
GROUP BY ROLLUP(topic, question_type, difficulty)""",
)
def error_tree(spark, sf_dir):
    return learning.error_tree(_attempts(spark, sf_dir), ["topic", "question_type", "difficulty"])


@query(
    "l10_association",
    f"""{_A}, p AS (SELECT question_type, topic, count(*) n FROM f_attempt WHERE correct=0 GROUP BY ALL)
SELECT question_type, topic, n, round(n*(SELECT sum(n) FROM p)/((SELECT sum(n) FROM p b WHERE b.question_type IS NOT DISTINCT FROM p.question_type)
 *(SELECT sum(n) FROM p c WHERE c.topic IS NOT DISTINCT FROM p.topic)),6)::DOUBLE lift FROM p""",
)
def association(spark, sf_dir):
    return learning.association(_attempts(spark, sf_dir), "question_type", "topic")


@query(
    "l11_classifier_quality",
    f"""{_A}, c AS (SELECT year(day) y, topic, count(*) FILTER (correct=1 AND self_rating=1) tp,
 count(*) FILTER (correct=0 AND self_rating=1) fp, count(*) FILTER (correct=1 AND self_rating=0) fn,
 count(*) FILTER (correct=0 AND self_rating=0) tn FROM f_attempt GROUP BY ALL)
SELECT CAST(y AS INT) "year", topic, round((tp+tn)/nullif(tp+tn+fp+fn,0),6) accuracy, round(tp/nullif(tp+fp,0),6) "precision",
 round(tp/nullif(tp+fn,0),6) recall, round(2*tp/nullif(2*tp+fp+fn,0),6) f1 FROM c""",
)
def classifier_quality(spark, sf_dir):
    rows = _attempts(spark, sf_dir).withColumn("year", F.year("day"))
    return learning.classifier_quality(rows, "correct", "self_rating", ["year", "topic"])


@query(
    "l12_error_flow",
    f"""{_DAYS}, s AS (SELECT learner_id, topic, day, CASE WHEN correct>=0.8 THEN 'mastered' WHEN correct>=0.5 THEN 'shaky' ELSE 'wrong' END st
 FROM days), m AS (SELECT st from_state, lead(st) OVER (PARTITION BY learner_id, topic ORDER BY day) to_state FROM s)
SELECT from_state, to_state, count(*) n FROM m WHERE to_state IS NOT NULL GROUP BY ALL""",
)
def error_flow(spark, sf_dir):
    return learning.error_flow(_attempts(spark, sf_dir))


@query(
    "l13_strategy_comparison",
    f"""{_A} SELECT question_type, round(avg(correct),9) success, round(avg(gain),9) mean_gain, count(*) n
FROM f_attempt GROUP BY question_type""",
)
def strategy_comparison(spark, sf_dir):
    return learning.strategy_comparison(_attempts(spark, sf_dir), "question_type")


@query(
    "l13_mastery_timeline",
    f"""{_A} SELECT topic, CASE WHEN correct=1 THEN 'right' ELSE 'wrong' END status, CAST(min(day) AS VARCHAR) first_day,
 CAST(max(day) AS VARCHAR) last_day FROM f_attempt GROUP BY ALL""",
)
def mastery_timeline(spark, sf_dir):
    return _text(learning.mastery_timeline(_attempts(spark, sf_dir)), "first_day", "last_day")


_STANDARD = ("view", "click", "purchase")
_PATHS = """paths AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) n, count(DISTINCT event_type) k,
 count(DISTINCT event_type) FILTER (event_type IN ('view','click','purchase')) shared,
 concat_ws(',', CASE WHEN NOT bool_or(event_type='click') THEN 'click' END,
  CASE WHEN NOT bool_or(event_type='purchase') THEN 'purchase' END, CASE WHEN NOT bool_or(event_type='view') THEN 'view' END) left_out
 FROM events GROUP BY 1, 2)"""


@query(
    "l14_step_paths",
    f"""WITH {_PATHS} SELECT user_id, CAST(d AS VARCHAR) "day", left_out, round(shared/n,6) efficiency,
 round(shared/(k+3-shared),6) similarity FROM paths""",
)
def step_paths(spark, sf_dir):
    return _text(learning.step_paths(table(spark, sf_dir, "events"), _STANDARD), "day")


@query(
    "l14_similarity_histogram",
    f"""WITH {_PATHS} SELECT CAST(floor(round(shared/(k+3-shared),6)/0.25) AS BIGINT) bucket, count(*) n FROM paths GROUP BY 1""",
)
def similarity_histogram(spark, sf_dir):
    paths = learning.step_paths(table(spark, sf_dir, "events"), _STANDARD)
    return learning.histogram(paths, "similarity", 0.25)


@query(
    "l15_standard_scores",
    f"""{_A}, s AS (SELECT topic, score, avg(score) OVER (PARTITION BY topic) m, stddev_pop(score) OVER (PARTITION BY topic) sd,
 percent_rank() OVER (PARTITION BY topic ORDER BY score) pr FROM f_attempt)
SELECT topic, score, count(*) n, round(any_value((score-m)/sd),5) z_score, round(any_value(pr),6) percent_rank
FROM s GROUP BY topic, score""",
)
def standard_scores(spark, sf_dir):
    return learning.standard_scores(_attempts(spark, sf_dir), "topic", "score")


def _box_sql(group: str, value: str) -> str:
    return f"""{_A}, q AS (SELECT {group}, quantile_cont({value},0.25) q1, quantile_cont({value},0.5) med, quantile_cont({value},0.75) q3,
 stddev({value})/avg({value}) cv FROM f_attempt GROUP BY {group})
SELECT q.{group}, round(any_value(q1),4) q1, round(any_value(med),4) median, round(any_value(q3),4) q3,
 CAST(count(*) FILTER ({value}<q1-1.5*(q3-q1) OR {value}>q3+1.5*(q3-q1)) AS BIGINT) outliers, round(any_value(cv),6) variation
FROM f_attempt a JOIN q ON q.{group}=a.{group} GROUP BY q.{group}"""


@query("l16_score_distribution", _box_sql("topic", "score"))
def score_distribution(spark, sf_dir):
    return learning.box_plot(_attempts(spark, sf_dir), "topic", "score")


@query("l25_box_plot", _box_sql("question_type", "gain"))
def box_plot(spark, sf_dir):
    return learning.box_plot(_attempts(spark, sf_dir), "question_type", "gain")


@query(
    "l16_percentiles",
    f"""{_A} SELECT round(quantile_cont(score,0.1),4) p10, round(quantile_cont(score,0.9),4) p90, round(quantile_cont(score,0.99),4) p99
FROM f_attempt""",
)
def score_percentiles(spark, sf_dir):
    found = ranking.percentiles(_attempts(spark, sf_dir), [], "score", {"p10": 0.1, "p90": 0.9, "p99": 0.99})
    return found.select(*[F.round(name, 4).alias(name) for name in found.columns])


@query(
    "l17_rank_changes",
    f"""{_A}, p AS (SELECT learner_id, CAST(year(day) AS INT) y, sum(correct) points FROM f_attempt GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY y ORDER BY points DESC) place FROM p)
SELECT learner_id, y "year", CAST(points AS BIGINT) points, place,
 lag(place) OVER (PARTITION BY learner_id ORDER BY y)-place change FROM r""",
)
def rank_changes(spark, sf_dir):
    return learning.rank_changes(_attempts(spark, sf_dir))


@query(
    "l18_value_added",
    f"""{_A}, r AS (SELECT teacher_id, gain-avg(gain) OVER (PARTITION BY topic) d FROM f_attempt)
SELECT teacher_id, count(*) n, round(avg(d),8) value_added, round(stddev(d)/sqrt(count(*)),8) error FROM r GROUP BY teacher_id""",
)
def value_added(spark, sf_dir):
    return learning.value_added(_attempts(spark, sf_dir))


@query(
    "l19_learning_track",
    f"""{_A}, d AS (SELECT learner_id, day, avg(score) s FROM f_attempt GROUP BY ALL),
r AS (SELECT *, avg(s) OVER w m, stddev(s) OVER w sd, count(s) OVER w n FROM d
 WINDOW w AS (PARTITION BY learner_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT learner_id, CAST(day AS VARCHAR) "day", round(s,4) score, round(m,4) mean,
 coalesce(abs((s-m)/nullif(sd,0))>3.0,false) AND n=5 anomaly FROM r""",
)
def learning_track(spark, sf_dir):
    return _text(learning.learning_track(_attempts(spark, sf_dir)), "day")


@query(
    "l20_radar",
    f"""{_A}, y AS (SELECT year(min(day)) f, year(max(day)) l FROM f_attempt)
SELECT topic, round(avg(correct) FILTER (year(day)=f),9) "begin", round(avg(correct) FILTER (year(day)=l),9) "end"
FROM f_attempt, y GROUP BY topic""",
)
def radar(spark, sf_dir):
    return learning.radar(_attempts(spark, sf_dir))


@query(
    "l21_risk_shares",
    f"""{_W}, c AS (SELECT snapshot_date, risk_level, count(*) n FROM f_warning GROUP BY ALL)
SELECT CAST(snapshot_date AS VARCHAR) snapshot_date, risk_level, n, round(n/sum(n) OVER (PARTITION BY c.snapshot_date),6) share FROM c""",
)
def risk_shares(spark, sf_dir):
    return _text(learning.risk_shares(table(spark, sf_dir, "f_warning")), "snapshot_date")


@query(
    "l21_time_to_clear",
    f"""{_W}, s AS (SELECT student_id, min(snapshot_date) since FROM f_warning WHERE risk_level='high' GROUP BY student_id)
SELECT s.student_id, CAST(any_value(since) AS VARCHAR) since, CAST(min(snapshot_date) AS VARCHAR) cleared,
 CAST(min(snapshot_date)-any_value(since) AS INT) AS days
FROM s LEFT JOIN f_warning w ON w.student_id=s.student_id AND w.risk_level<>'high' AND w.snapshot_date>since GROUP BY s.student_id""",
)
def time_to_clear(spark, sf_dir):
    return _text(learning.time_to_clear(table(spark, sf_dir, "f_warning"), "high"), "since", "cleared")


@query(
    "l21_intervention_effect",
    f"""{_W}, s AS (SELECT student_id, min(snapshot_date) since FROM f_warning WHERE risk_level='high' GROUP BY student_id)
SELECT s.student_id, round(avg(attendance_rate) FILTER (snapshot_date<since),9) "before",
 round(avg(attendance_rate) FILTER (snapshot_date>=since),9) "after"
FROM s JOIN f_warning w ON w.student_id=s.student_id GROUP BY s.student_id""",
)
def intervention_effect(spark, sf_dir):
    return learning.intervention_effect(table(spark, sf_dir, "f_warning"), "high")


@query(
    "l22_item_analysis",
    f"""{_A}, l AS (SELECT learner_id, sum(correct) p FROM f_attempt GROUP BY learner_id),
r AS (SELECT learner_id, percent_rank() OVER (ORDER BY p) pr FROM l)
SELECT question_id, round(avg(correct),9) success, max(difficulty) nominal,
 round(avg(correct) FILTER (pr>=0.73)-avg(correct) FILTER (pr<=0.27),6) discrimination
FROM f_attempt a JOIN r ON r.learner_id=a.learner_id GROUP BY question_id""",
)
def item_analysis(spark, sf_dir):
    return learning.item_analysis(_attempts(spark, sf_dir))


@query(
    "l23_coverage_tree",
    f"""{_A} SELECT topic, question_type, count(*) n, count(DISTINCT question_id) questions FROM f_attempt
GROUP BY ROLLUP(topic, question_type)""",
)
def coverage_tree(spark, sf_dir):
    return learning.coverage_tree(_attempts(spark, sf_dir), ["topic", "question_type"])


@query(
    "l23_co_occurrence",
    f"""{_A}, d AS (SELECT DISTINCT learner_id, topic FROM f_attempt)
SELECT a.topic topic_a, b.topic topic_b, count(*) learners FROM d a JOIN d b ON a.learner_id=b.learner_id AND a.topic<b.topic GROUP BY ALL""",
)
def co_occurrence(spark, sf_dir):
    return learning.co_occurrence(_attempts(spark, sf_dir))


@query(
    "l24_review_degrees",
    f"""{_A}, g AS (SELECT teacher_id p, count(*) given FROM f_attempt GROUP BY 1), r AS (SELECT learner_id p, count(*) received FROM f_attempt GROUP BY 1)
SELECT coalesce(g.p,r.p) person, coalesce(given,0) given, coalesce(received,0) received FROM g FULL JOIN r ON g.p=r.p""",
)
def review_degrees(spark, sf_dir):
    edges = _attempts(spark, sf_dir).select(F.col("teacher_id").alias("reviewer"), F.col("learner_id").alias("reviewed"))
    return learning.review_degrees(edges)


@query(
    "l24_rater_agreement",
    f"""{_A}, c AS (SELECT question_id, count(*) n, sum(correct) y FROM f_attempt GROUP BY question_id)
SELECT question_id, n, round((y*(y-1)+(n-y)*(n-y-1))/nullif(n*(n-1),0),6) agreement FROM c""",
)
def rater_agreement(spark, sf_dir):
    return learning.rater_agreement(_attempts(spark, sf_dir), "question_id", "correct")


@query(
    "l25_contribution",
    f"""{_A}, c AS (SELECT topic, learner_id, sum(correct) p FROM f_attempt GROUP BY ALL)
SELECT topic, learner_id, CAST(p AS BIGINT) points, round(p/nullif(sum(p) OVER (PARTITION BY topic),0),8) share FROM c""",
)
def contribution(spark, sf_dir):
    return learning.contribution(_attempts(spark, sf_dir))


@query(
    "l26_mastery_map",
    f"""{_A} SELECT learner_id, topic, round(avg(correct),9) rate,
 CASE WHEN avg(correct)>=0.8 THEN 'mastered' WHEN avg(correct)>=0.5 THEN 'partial' ELSE 'open' END level FROM f_attempt GROUP BY ALL""",
)
def mastery_map(spark, sf_dir):
    return learning.mastery_map(_attempts(spark, sf_dir))


@query(
    "l26_strategy_match",
    f"""{_A}, styles AS (SELECT learner_id, CASE WHEN avg(self_rating)>avg(correct) THEN 'confident' ELSE 'careful' END style
 FROM f_attempt GROUP BY learner_id),
cells AS (SELECT style, question_type, round(avg(correct),9) fit, count(*) n FROM f_attempt JOIN styles USING (learner_id) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY style ORDER BY fit DESC, n DESC, question_type)=1 suits FROM cells""",
)
def strategy_match(spark, sf_dir):
    attempts = _attempts(spark, sf_dir)
    return learning.strategy_match(attempts, learning.learning_styles(attempts), "question_type")


@query(
    "l27_list_quality",
    f"""{with_views("f_external")}, {_SCORED}, {_ranked_sql("top", 10)},
pair AS (SELECT a.query_id, avg(list_dot_product(x.v, y.v)) s FROM top a JOIN top b ON a.query_id=b.query_id AND a.item_id<b.item_id
 JOIN unit x ON x.vec_id=a.item_id JOIN unit y ON y.vec_id=b.item_id GROUP BY a.query_id)
SELECT round((SELECT count(*) FROM top t JOIN (SELECT DISTINCT query_id, ext_id FROM f_external) e
  ON e.query_id=t.query_id AND e.ext_id=t.item_id)/count(*),6) hit_rate,
 round(count(DISTINCT item_id)/(SELECT count(*) FROM embeddings),6) coverage, (SELECT round(1-avg(s),5) FROM pair) diversity FROM top""",
)
def list_quality(spark, sf_dir):
    items = table(spark, sf_dir, "f_item").select("question_id", "embedding")
    found = top_k_similar(
        items.select(F.col("question_id").alias("query_id"), "embedding"),
        items.select(F.col("question_id").alias("item_id"), "embedding"),
        10,
    )
    return learning.list_quality(found, table(spark, sf_dir, "f_external"), items)


def _tier_sql(seconds: int) -> str:
    return f"""SELECT strftime(to_timestamp(floor(epoch(ts)/{seconds})*{seconds}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') slot_start, count(*) n,
 round(avg(value),9) mean_value FROM events GROUP BY 1"""


def _tier(spark, sf_dir, every):
    rows = learning.refresh_tier(table(spark, sf_dir, "events"), every)
    return rows.withColumn("slot_start", F.date_format("slot_start", "yyyy-MM-dd HH:mm:ss"))


@query("l28_refresh_5_minutes", _tier_sql(300))
def refresh_5_minutes(spark, sf_dir):
    return _tier(spark, sf_dir, "5 minutes")


@query("l28_refresh_10_minutes", _tier_sql(600))
def refresh_10_minutes(spark, sf_dir):
    return _tier(spark, sf_dir, "10 minutes")


@query("l28_refresh_15_minutes", _tier_sql(900))
def refresh_15_minutes(spark, sf_dir):
    return _tier(spark, sf_dir, "15 minutes")


@query("l28_refresh_daily", _tier_sql(86400))
def refresh_daily(spark, sf_dir):
    return _tier(spark, sf_dir, "1 day")


@query("l28_refresh_weekly", _tier_sql(604800))
def refresh_weekly(spark, sf_dir):
    return _tier(spark, sf_dir, "7 days")


_HEARTBEAT = "2100-01-01 00:00:00"


def _streamed_tier(spark, sf_dir, every, delay):
    """The events as shuffled files, one a batch, and a heartbeat that closes all slots."""
    events, feed, root = table(spark, sf_dir, "events").select("event_id", "ts", "value"), new_folder(spark, "event-feed"), new_folder(spark, "tier")
    events.repartition(6, F.xxhash64("event_id")).write.parquet(feed)
    for step in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(feed)
        tiers.start(tiers.tier_stream(stream, every, delay), root).awaitTermination()
        if not step:
            beat = events.limit(0).union(spark.sql(f"SELECT -1L, timestamp '{_HEARTBEAT}', CAST(NULL AS DOUBLE)"))
            beat.coalesce(1).write.mode("append").parquet(feed)
    return root


@query(
    "l28_stream_daily",
    f"""SELECT slot_start, n, round(mean_value,6) mean_value FROM ({_tier_sql(86400)})""",
)
def streamed_daily(spark, sf_dir):
    rows = tiers.refreshed(spark, _streamed_tier(spark, sf_dir, "1 day", "2 days"))
    # nine digits first, as in the batch tiers: the order in which a slot's values were added must not decide a tie
    mean = F.round(F.round("mean_value", 9), 6).alias("mean_value")
    return rows.select(F.date_format("slot_start", "yyyy-MM-dd HH:mm:ss").alias("slot_start"), "n", mean)
