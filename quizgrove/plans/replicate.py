"""Queries over replication, reconciliation and change data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizgrove.functions import values
from quizgrove.functions.values import latency_ms
from quizgrove.operators import access, replicate
from quizgrove.plans.fixtures import AS_OF, table, with_views
from quizgrove.plans.registry import query
from quizgrove.session import new_folder
from quizgrove.sources import changes, tables
from quizgrove.streaming import feeds, loads, polling

_ANY_BAD = 10**9


def _warnings(spark, sf_dir):
    return table(spark, sf_dir, "f_warning")


def _text(*names):
    return [F.col(name).cast("string").alias(name) for name in names]


# --- batch -----------------------------------------------------------------------------------


@query("s1_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority='2-HIGH' AND o_totalprice>=100000")
def scan(spark, sf_dir):
    return tables.scan(
        spark,
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderpriority=:priority AND o_totalprice>=:floor",
        {"priority": "2-HIGH", "floor": 100000},
        orders=table(spark, sf_dir, "orders"),
    )


@query(
    "s7_schema",
    """SELECT CAST(position AS INT) position, name, type, (SELECT count(*) FROM customer) n_rows FROM (VALUES
 (0,'c_custkey','bigint'),(1,'c_name','string'),(2,'c_nationkey','int'),(3,'c_acctbal','double'),(4,'c_mktsegment','string'))
 t(position, name, type)""",
)
def schema(spark, sf_dir):
    return tables.describe(table(spark, sf_dir, "customer"))


@query("c1_full_sync", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def full_sync(spark, sf_dir):
    path = new_folder(spark, "full-copy")
    tables.write_full(table(spark, sf_dir, "f_source"), path)
    return tables.read_full(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


_ORDERS = (
    ("o_orderkey", "bigint(20)", False, "PRI"),
    ("o_custkey", "int(11) unsigned", True, "MUL"),
    ("o_orderstatus", "char(1)", True, ""),
    ("o_orderdate", "date", True, ""),
)


@query(
    "c1_table_sync",
    """SELECT o_orderkey, CAST(o_custkey AS BIGINT) o_custkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) o_orderdate,
 (SELECT count(*) FROM orders) n_rows FROM orders""",
)
def table_sync(spark, sf_dir):
    path = new_folder(spark, "synced-orders")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    target, copied = tables.sync_table(table(spark, sf_dir, "orders"), _ORDERS, name, buckets=8, path=path)
    return target.withColumns({"o_orderdate": F.col("o_orderdate").cast("string"), "n_rows": F.lit(copied.get["n_rows"])})


@query("a15_copied_rows", "SELECT count(*) n_rows FROM lineitem")
def copied_rows(spark, sf_dir):
    observed = tables.write_full(table(spark, sf_dir, "lineitem"), new_folder(spark, "full-copy"))
    return spark.createDataFrame([(observed.get["n_rows"],)], "n_rows bigint")


_TYPED = (
    ("l_orderkey", "bigint(20)", False),
    ("l_linenumber", "tinyint(4) unsigned", True),
    ("l_quantity", "decimal(12,2)", True),
    ("l_returnflag", "varchar(1)", True),
    ("l_shipdate", "date", True),
)


@query(
    "s8_typed_copy",
    """SELECT l_orderkey, CAST(l_linenumber AS SMALLINT) l_linenumber, CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR) l_quantity,
 l_returnflag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) l_shipdate, 'bigint,smallint,decimal(12,2),string,date' kinds FROM lineitem""",
)
def typed_copy(spark, sf_dir):
    rows = tables.typed(table(spark, sf_dir, "lineitem"), tables.spark_schema(_TYPED))
    kinds = F.concat_ws(",", *[F.typeof(name) for name in rows.columns]).alias("kinds")
    return rows.select(kinds, "l_orderkey", "l_linenumber", "l_returnflag", *_text("l_quantity", "l_shipdate"))


@query("s9_bucketed_table", "SELECT o_orderkey, count(*) n_lines FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY o_orderkey")
def bucketed_table(spark, sf_dir):
    joined = []
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        path = new_folder(spark, f"bucketed-{name}")
        target = path.rsplit("/", 1)[1].replace("-", "_")
        tables.create_table(table(spark, sf_dir, name).select(key), target, [key], buckets=8, path=path)
        joined.append(spark.table(target))
    orders, lines = joined
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_orderkey").agg(F.count("*").alias("n_lines"))


_SYNC = with_views("f_source", "f_target")
_NEW = """new AS (SELECT s.* FROM f_source s WHERE snapshot_date>=(SELECT max(snapshot_date) FROM f_target)
 AND NOT EXISTS (SELECT 1 FROM f_target t WHERE t.o_orderkey=s.o_orderkey AND t.snapshot_date=s.snapshot_date))"""
_SYNC_KEYS = ("snapshot_date", "o_orderkey")


def _pair(spark, sf_dir):
    return table(spark, sf_dir, "f_source"), table(spark, sf_dir, "f_target")


@query("a7_high_water_mark", f"{_SYNC} SELECT CAST(max(snapshot_date) AS VARCHAR) mark FROM f_target")
def high_water_mark(spark, sf_dir):
    return replicate.high_water_mark(_pair(spark, sf_dir)[1], "snapshot_date").select(*_text("mark"))


@query("c2_incremental", f"{_SYNC}, {_NEW} SELECT o_orderkey, o_totalprice, CAST(snapshot_date AS VARCHAR) snapshot_date FROM new")
def incremental(spark, sf_dir):
    source, target = _pair(spark, sf_dir)
    rows = replicate.incremental_rows(source, target, "snapshot_date", _SYNC_KEYS)
    return rows.select("o_orderkey", "o_totalprice", *_text("snapshot_date"))


_INSERTED = f"""{_SYNC} SELECT o_orderkey, o_totalprice FROM f_target
UNION ALL SELECT o_orderkey, o_totalprice FROM f_source WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f_target)"""


@query("c3_insert_skip", _INSERTED)
def insert_skip(spark, sf_dir):
    source, target = _pair(spark, sf_dir)
    return replicate.insert_skip(target, source, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    "j11_anti_null_safe",
    """SELECT s.l_orderkey, s.l_linenumber FROM lineitem s WHERE NOT EXISTS (SELECT 1 FROM lineitem t
 WHERE t.l_returnflag='R' AND t.l_orderkey=s.l_orderkey
  AND nullif(t.l_linestatus,'O') IS NOT DISTINCT FROM nullif(s.l_linestatus,'O'))""",
)
def anti_null_safe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("state", F.nullif("l_linestatus", F.lit("O")))
    target = rows.filter("l_returnflag = 'R'")
    return replicate.missing_rows(rows, target, ["l_orderkey", "state"], null_safe=True).select("l_orderkey", "l_linenumber")


@query(
    "c10_reconcile",
    f"""{_SYNC}, s AS (SELECT count(*) n, max(snapshot_date) d FROM f_source), t AS (SELECT count(*) n, max(snapshot_date) d FROM f_target)
SELECT s.n source_count, CAST(s.d AS VARCHAR) source_latest, t.n target_count, CAST(t.d AS VARCHAR) target_latest,
 s.n=t.n same_count, s.d=t.d same_latest, CAST(s.d-t.d AS INT) days_behind FROM s, t""",
)
def reconcile(spark, sf_dir):
    row = replicate.reconcile(*_pair(spark, sf_dir), "snapshot_date")
    return row.withColumns({name: F.col(name).cast("string") for name in ("source_latest", "target_latest")})


_VERIFIED = f"""{_SYNC}, p AS (SELECT s.o_orderkey sk, t.o_orderkey tk, s.o_custkey<>t.o_custkey c, s.o_orderstatus<>t.o_orderstatus st,
 s.o_totalprice<>t.o_totalprice pr, s.snapshot_date<>t.snapshot_date d FROM f_source s FULL JOIN f_target t ON s.o_orderkey=t.o_orderkey)
SELECT 'missing' check_name, count(*) FILTER (tk IS NULL) n_rows FROM p UNION ALL SELECT 'extra', count(*) FILTER (sk IS NULL) FROM p
UNION ALL SELECT 'changed_o_custkey', count(*) FILTER (c) FROM p UNION ALL SELECT 'changed_o_orderstatus', count(*) FILTER (st) FROM p
UNION ALL SELECT 'changed_o_totalprice', count(*) FILTER (pr) FROM p UNION ALL SELECT 'changed_snapshot_date', count(*) FILTER (d) FROM p"""


@query("c11_verify", _VERIFIED)
def verify(spark, sf_dir):
    return replicate.verify(*_pair(spark, sf_dir), ["o_orderkey"])


def _bucketed_pair(spark, sf_dir, keys=("o_orderkey",), buckets=8):
    """Names of bucketed copies of source and target."""
    names = []
    for label, side in zip(("source", "target"), _pair(spark, sf_dir), strict=True):
        path = new_folder(spark, f"copy-{label}")
        names.append(path.rsplit("/", 1)[1].replace("-", "_"))
        tables.create_table(side, names[-1], keys, buckets, path=path)
    return names


@query("c11_verify_colocated", _VERIFIED)
def verify_colocated(spark, sf_dir):
    source, target = _bucketed_pair(spark, sf_dir)
    return replicate.verify(spark.table(source), spark.table(target), ["o_orderkey"], colocated=True)


@query("c3_insert_colocated", _INSERTED)
def insert_colocated(spark, sf_dir):
    source, target = _bucketed_pair(spark, sf_dir)
    tables.insert_missing(spark.table(source), target, ["o_orderkey"], 8)
    return spark.table(target).select("o_orderkey", "o_totalprice")


@query(
    "j15_changed_rows",
    f"""{_SYNC} SELECT s.o_orderkey, 'o_totalprice' column_name, round(s.o_totalprice,2) source_value, round(t.o_totalprice,2) target_value
FROM f_source s JOIN f_target t ON s.o_orderkey=t.o_orderkey WHERE s.o_totalprice<>t.o_totalprice""",
)
def changed_rows(spark, sf_dir):
    rows = replicate.changed_rows(*_pair(spark, sf_dir), ["o_orderkey"])
    return rows.withColumns(
        {name: F.round(F.col(name).cast("double"), 2) for name in ("source_value", "target_value")}
    )


@query(
    "c12_gap",
    f"""{_SYNC}, n AS (SELECT (SELECT count(*) FROM f_source) a, (SELECT count(*) FROM f_target) b)
SELECT a source_count, b target_count, a-b difference, abs(a-b)<1000 healthy FROM n""",
)
def gap(spark, sf_dir):
    return replicate.gap(*_pair(spark, sf_dir))


_WARNING = with_views("f_warning")


@query(
    "a5_risk_group",
    f"""{_WARNING} SELECT risk_level, count(*) n_rows, round(avg(attendance_rate),9) mean_attendance,
 round(avg(submit_rate),9) mean_submit FROM f_warning GROUP BY risk_level""",
)
def risk_group(spark, sf_dir):
    return replicate.risk_groups(_warnings(spark, sf_dir))


@query("a4_count_maxdate", f"{_WARNING} SELECT count(*) n_rows, CAST(max(snapshot_date) AS VARCHAR) latest FROM f_warning")
def count_maxdate(spark, sf_dir):
    return replicate.latest_dates(_warnings(spark, sf_dir), "snapshot_date").select("n_rows", *_text("latest"))


@query(
    "t3_newest",
    f"""{_WARNING} SELECT CAST(snapshot_date AS VARCHAR) snapshot_date, student_id, risk_level FROM f_warning w
ORDER BY w.snapshot_date DESC, student_id DESC LIMIT 100""",
)
def newest(spark, sf_dir):
    rows = replicate.newest(_warnings(spark, sf_dir), ["snapshot_date", "student_id"])
    return rows.select(*_text("snapshot_date"), "student_id", "risk_level")


@query(
    "t4_sample",
    f"""{_WARNING} SELECT CAST(snapshot_date AS VARCHAR) snapshot_date, student_id, risk_level FROM f_warning w
ORDER BY w.snapshot_date, student_id LIMIT 5""",
)
def sample(spark, sf_dir):
    rows = _warnings(spark, sf_dir).orderBy("snapshot_date", "student_id").limit(5)
    return rows.select(*_text("snapshot_date"), "student_id", "risk_level")


@query(
    "p14_since",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'""",
)
def since(spark, sf_dir):
    floor = F.lit("2000-01-01").cast("timestamp_ntz")
    return replicate.since(table(spark, sf_dir, "lineitem"), "l_shipdate", floor).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "a1_subject_counts",
    f"""{with_views("f_question")} SELECT count(*) total, count(*) FILTER (subject='1-URGENT') urgent,
 count(*) FILTER (subject='5-LOW') low FROM f_question WHERE enabled=1""",
)
def subject_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "f_question").filter("enabled = 1")
    return replicate.conditional_counts(rows, "subject", {"urgent": "1-URGENT", "low": "5-LOW"})


@query(
    "a3_total",
    f"""{with_views("f_question")} SELECT count(DISTINCT question_id) total FROM f_question WHERE enabled=1 AND subject='2-HIGH'""",
)
def total(spark, sf_dir):
    rows = access.matching(table(spark, sf_dir, "f_question"), {"enabled": 1, "subject": "2-HIGH"})
    return rows.agg(F.count_distinct("question_id").alias("total"))


@query(
    "a10_distributions",
    f"""{with_views("f_item")}, long AS (SELECT 'type_id' column_name, CAST(type_id AS VARCHAR) "value" FROM f_item
 UNION ALL SELECT 'grade_id', CAST(grade_id AS VARCHAR) FROM f_item UNION ALL SELECT 'subject_id', CAST(subject_id AS VARCHAR) FROM f_item)
SELECT column_name, "value", count(*) n_rows FROM long WHERE "value" IS NOT NULL GROUP BY ALL""",
)
def distributions(spark, sf_dir):
    return replicate.value_counts(table(spark, sf_dir, "f_item"), ["type_id", "grade_id", "subject_id"])


@query(
    "r12_info",
    """SELECT count(*) items, count(DISTINCT vec_id) questions, CAST(max(len(embedding)) AS INT) dimension FROM embeddings""",
)
def info(spark, sf_dir):
    return table(spark, sf_dir, "f_item").agg(
        F.count("*").alias("items"),
        F.count_distinct("question_id").alias("questions"),
        F.max(F.size("embedding")).alias("dimension"),
    )


# --- change data, as a batch -----------------------------------------------------------------

_PARSED = f"""{with_views("f_change")},
parsed AS (SELECT kafka_offset, topic, CASE WHEN json_valid(value) THEN value END v FROM f_change),
change AS (SELECT kafka_offset, topic, date '1970-01-01' + CAST(v->>'$.snapshot_date' AS INT) snapshot_date, v->>'$.student_id' student_id,
 CAST(CAST(v->>'$.attendance_rate' AS DECIMAL(5,4)) AS DOUBLE) attendance_rate, CAST(v->>'$.violation_cnt' AS INT) violation_cnt,
 v->>'$.risk_level' risk_level, v->>'$.__op' op, CAST(v->>'$.__ts_ms' AS BIGINT) ts_ms FROM parsed WHERE v IS NOT NULL)"""
_LATEST = f"""{_PARSED}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, student_id
 ORDER BY ts_ms DESC, kafka_offset DESC) rn FROM change WHERE topic='srv.src.abc_warning') x WHERE rn=1)"""
_LATEST_AND_WARNINGS = with_views("f_warning") + ", " + _LATEST.removeprefix("WITH ")
_ROW = """CAST(snapshot_date AS VARCHAR) snapshot_date, student_id, attendance_rate, violation_cnt, risk_level, op, ts_ms"""


def _changes(spark, sf_dir):
    return changes.parsed(table(spark, sf_dir, "f_change"))


def _shown(rows):
    return rows.select(
        *_text("snapshot_date"), "student_id", F.col("attendance_rate").cast("double").alias("attendance_rate"),
        "violation_cnt", "risk_level", "op", "ts_ms",
    )


def _latest(spark, sf_dir):
    rows = changes.good(_changes(spark, sf_dir)).filter(F.regexp_extract("topic", changes.TOPIC, 3) == "abc_warning")
    return replicate.latest_per_key(rows.drop("ok", "value", "topic"), feeds.KEYS)


@query("c5_cdc_latest", f"{_LATEST} SELECT {_ROW} FROM latest")
def cdc_latest(spark, sf_dir):
    return _shown(_latest(spark, sf_dir))


@query(
    "p15_point_lookup",
    f"""{_LATEST_AND_WARNINGS}
SELECT CAST(w.snapshot_date AS VARCHAR) snapshot_date, w.student_id, l.op, l.ts_ms FROM f_warning w
JOIN latest l ON l.snapshot_date=w.snapshot_date AND l.student_id=w.student_id""",
)
def point_lookup(spark, sf_dir):
    wanted = _warnings(spark, sf_dir).select("snapshot_date", "student_id")
    rows = changes.good(_changes(spark, sf_dir)).filter(F.regexp_extract("topic", changes.TOPIC, 3) == "abc_warning")
    found = replicate.latest_per_key(rows.join(wanted, list(feeds.KEYS), "left_semi"), feeds.KEYS)
    return found.select(*_text("snapshot_date"), "student_id", "op", "ts_ms")


@query("c6_live_rows", f"{_LATEST} SELECT {_ROW} FROM latest WHERE op<>'d'")
def live_rows(spark, sf_dir):
    return _shown(replicate.live_rows(_latest(spark, sf_dir)))


@query("c8_op_stats", f"{_PARSED} SELECT op, count(*) n_rows, max(ts_ms) latest_ts_ms FROM change WHERE op IS NOT NULL GROUP BY op")
def op_stats(spark, sf_dir):
    return replicate.op_statistics(_changes(spark, sf_dir))


_AS_OF_MS = "CAST(epoch_ms(TIMESTAMP '2024-06-01') AS BIGINT)"


@query(
    "c13_latency",
    f"""{_PARSED}, last AS (SELECT ts_ms FROM change ORDER BY ts_ms DESC, kafka_offset DESC LIMIT 10)
SELECT count(*) n_rows, round(avg({_AS_OF_MS}-ts_ms),4) mean_ms, max({_AS_OF_MS}-ts_ms) max_ms, min({_AS_OF_MS}-ts_ms) min_ms FROM last""",
)
def latency(spark, sf_dir):
    return replicate.latency(_changes(spark, sf_dir), F.lit("2024-06-01T00:00:00Z").cast("timestamp"))


@query(
    "c13_latency_all",
    f"""{_PARSED}
SELECT count(*) n_rows, round(avg({_AS_OF_MS}-ts_ms),4) mean_ms, max({_AS_OF_MS}-ts_ms) max_ms, min({_AS_OF_MS}-ts_ms) min_ms FROM change""",
)
def latency_all(spark, sf_dir):
    return replicate.latency(_changes(spark, sf_dir), F.lit("2024-06-01T00:00:00Z").cast("timestamp"), last=None)


@query(
    "c13_latency_p99",
    f"""{_PARSED} SELECT round(quantile_cont(CAST({_AS_OF_MS}-ts_ms AS DOUBLE),0.99),3) p99_ms FROM change WHERE ts_ms IS NOT NULL""",
)
def latency_p99(spark, sf_dir):
    found = replicate.latency_percentile(_changes(spark, sf_dir), F.lit("2024-06-01T00:00:00Z").cast("timestamp"))
    return found.select(F.round("p99_ms", 3).alias("p99_ms"))


@query(
    "f18_json_field",
    f"""{with_views("f_change")} SELECT kafka_offset, json_extract_string(v,'$.__op') op, json_extract_string(v,'$.__ts_ms') ts_ms,
 json_extract_string(v,'$.student_id') student_id, CAST(NULL AS VARCHAR) gone
FROM (SELECT kafka_offset, CASE WHEN json_valid(value) THEN value END v FROM f_change)""",
)
def json_fields(spark, sf_dir):
    names = ("op", "ts_ms", "student_id", "gone")
    return table(spark, sf_dir, "f_change").select("kafka_offset", *[values.json_field(F.col("value"), name).alias(name) for name in names])


@query("s10_append", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus='F'")
def append(spark, sf_dir):
    rows, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), new_folder(spark, "appended")
    tables.append_rows(rows.drop("o_orderstatus"), path)
    tables.append_rows(rows.filter("o_orderstatus = 'F'").drop("o_orderstatus"), path)
    return spark.read.parquet(path)


@query(
    "c13_latency_sketch",
    f"""{_PARSED} SELECT true close_to_p99, count(*) n_rows FROM change WHERE ts_ms IS NOT NULL""",
)
def latency_sketch(spark, sf_dir):
    """P99 from sketches of single days, held against the ranks of all changes: within one percent of them."""
    rows = changes.good(_changes(spark, sf_dir)).filter("ts_ms IS NOT NULL")
    as_of = F.lit("2024-06-01T00:00:00Z").cast("timestamp")
    sketches = rows.groupBy("snapshot_date").agg(replicate.latency_sketch(F.col("ts_ms")).alias("ts_sketch"))
    found = replicate.sketched_latency(sketches, as_of)
    below = rows.agg(F.count_if(latency_ms(as_of, F.col("ts_ms")) <= found.select("p99_ms").scalar()).alias("below"))
    share = below.select("below").scalar() / F.col("n_rows")
    return found.select((F.abs(share - 0.99) < 0.01).alias("close_to_p99"), "n_rows")


@query("s12_route", f"""{with_views("f_change")} SELECT kafka_offset, split_part(topic,'.',3) "table" FROM f_change""")
def route(spark, sf_dir):
    return changes.routed(table(spark, sf_dir, "f_change")).select("kafka_offset", "table")


@query("c15_routing", f"""{with_views("f_change")} SELECT split_part(topic,'.',3) "table", count(*) n_rows FROM f_change GROUP BY 1""")
def routing(spark, sf_dir):
    return changes.routed(table(spark, sf_dir, "f_change")).groupBy("table").agg(F.count("*").alias("n_rows"))


@query(
    "s14_json",
    f"{_PARSED} SELECT kafka_offset, {_ROW} FROM change",
)
def json_rows(spark, sf_dir):
    rows = changes.good(_changes(spark, sf_dir))
    return rows.select("kafka_offset", *_shown(rows).columns).withColumns(
        {"snapshot_date": F.col("snapshot_date").cast("string"), "attendance_rate": F.col("attendance_rate").cast("double")}
    )


@query("s15_quarantine", f"""{with_views("f_change")} SELECT kafka_offset, topic, value FROM f_change WHERE NOT json_valid(value)""")
def quarantine(spark, sf_dir):
    return changes.quarantined(_changes(spark, sf_dir))


_ENVELOPE = """SELECT o_orderkey kafka_offset, to_json(named_struct(
 'before', CASE WHEN o_orderstatus<>'O' THEN named_struct('id', o_orderkey, 'price', o_totalprice-1) END,
 'after', CASE WHEN o_orderstatus<>'P' THEN named_struct('id', o_orderkey, 'price', o_totalprice) END,
 'op', CASE o_orderstatus WHEN 'O' THEN 'c' WHEN 'F' THEN 'u' ELSE 'd' END, 'ts_ms', o_custkey,
 'source', named_struct('db', 'src', 'table', 'orders'))) value FROM {orders}"""


@query(
    "s13_unwrap",
    """SELECT o_orderkey kafka_offset, o_orderkey id, round(CASE WHEN o_orderstatus='P' THEN o_totalprice-1 ELSE o_totalprice END,2) price,
 CASE o_orderstatus WHEN 'O' THEN 'c' WHEN 'F' THEN 'u' ELSE 'd' END op, o_custkey ts_ms, 'src' source_db, 'orders' source_table,
 o_orderstatus='P' deleted FROM orders""",
)
def unwrap(spark, sf_dir):
    rows = changes.unwrapped(spark.sql(_ENVELOPE, orders=table(spark, sf_dir, "orders")), "id bigint, price double")
    return rows.withColumn("price", F.round("price", 2))


_BROKEN = """SELECT o_orderkey kafka_offset, CASE o_orderkey%5 WHEN 1 THEN '{{bad' WHEN 2 THEN '{{"op":"c","ts_ms":1}}'
 WHEN 3 THEN '{{"after":{{"id":1,"price":2.5}}}}' WHEN 4 THEN NULL
 ELSE concat('{{"op":"c","after":{{"id":', o_orderkey, ',"price":1.5}}}}') END value FROM {orders}"""


@query(
    "s13_bad_envelopes",
    f"SELECT kafka_offset, value FROM ({_BROKEN.format(orders='orders')}) WHERE kafka_offset%5 IN (1,2,3)",
)
def bad_envelopes(spark, sf_dir):
    feed = spark.sql(_BROKEN, orders=table(spark, sf_dir, "orders"))
    return changes.bad_envelopes(feed, "id bigint, price double")


# --- streams ---------------------------------------------------------------------------------


def _feed(spark, rows, label, files=8):
    path = new_folder(spark, label)
    rows.repartition(files).write.parquet(path)
    return path


def _finish(query_handle):
    query_handle.awaitTermination()


def _upserted(spark, sf_dir, twice=None):
    """The copy after a feed. ``twice``: which records it delivers again, in other files."""
    rows, root = table(spark, sf_dir, "f_change"), new_folder(spark, "upsert")
    feed = _feed(spark, rows if twice is None else rows.unionByName(rows.filter(twice)), "change-feed")
    stream = changes.file_changes(spark, feed, files_per_batch=2)
    stream = stream if twice is None else changes.delivered_once(stream)
    work = feeds.upsert_batch(f"{root}/copy", max_bad=_ANY_BAD, table="abc_warning", compact_every=2)
    _finish(feeds.start(stream, work, f"{root}/checkpoint"))
    return feeds.current(spark, f"{root}/copy")


@query("c5_stream_upsert", f"{_LATEST} SELECT {_ROW} FROM latest")
def stream_upsert(spark, sf_dir):
    return _shown(_upserted(spark, sf_dir))


@query("c5_at_least_once", f"{_LATEST} SELECT {_ROW} FROM latest")
def stream_redelivered(spark, sf_dir):
    return _shown(_upserted(spark, sf_dir, twice=F.col("kafka_offset") % 3 == 0))


@query(
    "c9_load_progress",
    f"""{with_views("f_change")},
record AS (SELECT kafka_offset, json_valid(value) ok, CASE WHEN json_valid(value) THEN json_extract_string(value,'$.__op') END op
 FROM f_change WHERE split_part(topic,'.',3)='abc_warning')
SELECT 4 batches, count(*) FILTER (WHERE ok) good, count(*) FILTER (WHERE NOT ok) bad, max(kafka_offset) last_offset,
 count(*) FILTER (WHERE op='c') op_c, count(*) FILTER (WHERE op='u') op_u, count(*) FILTER (WHERE op='d') op_d,
 count(*) FILTER (WHERE op='r') op_r, count(*) FILTER (WHERE op NOT IN ('c','u','d','r')) op_other FROM record""",
)
def load_progress(spark, sf_dir):
    """A load in two runs with a pause between them: what its progress table adds up to."""
    root = new_folder(spark, "load")
    feed = _feed(spark, table(spark, sf_dir, "f_change"), "load-feed")
    work = feeds.upsert_batch(f"{root}/copy", max_bad=_ANY_BAD, table="abc_warning")
    load = loads.Load(spark, root, lambda: changes.file_changes(spark, feed, files_per_batch=2), work)
    load.run()
    load.pause()
    load.run()
    load.stop()
    return load.totals()


@query(
    "c7_snapshot_stream",
    f"""{_LATEST_AND_WARNINGS}
SELECT CAST(coalesce(l.snapshot_date, w.snapshot_date) AS VARCHAR) snapshot_date, coalesce(l.student_id, w.student_id) student_id,
 CASE WHEN l.op IS NULL THEN w.risk_level ELSE l.risk_level END risk_level, coalesce(l.op,'r') op
FROM f_warning w FULL JOIN latest l ON l.snapshot_date=w.snapshot_date AND l.student_id=w.student_id""",
)
def snapshot_stream(spark, sf_dir):
    snapshot = _warnings(spark, sf_dir).select("snapshot_date", "student_id", "risk_level")
    stream = _upserted(spark, sf_dir).select("snapshot_date", "student_id", "risk_level", "op", "ts_ms", "kafka_offset")
    rows = feeds.with_snapshot(snapshot, stream)
    return rows.select(*_text("snapshot_date"), "student_id", "risk_level", "op")


@query(
    "c4_stream_incremental",
    f"""{_SYNC}, {_NEW} SELECT o_orderkey, o_totalprice FROM f_target UNION ALL SELECT o_orderkey, o_totalprice FROM new""",
)
def stream_incremental(spark, sf_dir):
    source, target = _pair(spark, sf_dir)
    feed, root = new_folder(spark, "source-feed"), new_folder(spark, "polling")
    copy = polling.Target(f"{root}/copy", target.schema, "snapshot_date", tuple(_SYNC_KEYS), grain="year")
    polling.begin(target, copy)
    bounds = [None, "1998-01-01", "2001-01-01", None]
    for lower, upper in zip(bounds, bounds[1:], strict=False):
        part = source if lower is None else source.filter(F.col("snapshot_date") >= lower)
        part = part if upper is None else part.filter(F.col("snapshot_date") < upper)
        part.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(source.schema).parquet(feed)
        _finish(feeds.start(stream, polling.poll(copy, fold_every=2), f"{root}/checkpoint"))
    return polling.copied(spark, copy).select("o_orderkey", "o_totalprice")


_MUTATIONS = """SELECT c_custkey*3+{step} kafka_offset, 'srv.src.abc_warning' topic, to_json(named_struct(
 'snapshot_date', '2024-01-01', 'student_id', concat('S', c_custkey), 'attendance_rate', '0.9000',
 'violation_cnt', c_nationkey+{step}, 'risk_level', 'low', '__op', '{op}', '__ts_ms', 1704067200000+{step})) value
FROM {{customer}} WHERE {condition}"""


@query(
    "c14_mutation",
    """SELECT concat('S', c_custkey) student_id, CASE WHEN c_acctbal<0 THEN 'd' ELSE 'u' END op,
 CAST(c_nationkey+CASE WHEN c_acctbal<0 THEN 2 ELSE 1 END AS INT) violation_cnt FROM customer""",
)
def mutation(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    feed, root = new_folder(spark, "mutation-feed"), new_folder(spark, "mutation")
    for step, (op, condition) in enumerate((("c", "true"), ("u", "true"), ("d", "c_acctbal<0"))):
        rows = spark.sql(_MUTATIONS.format(step=step, op=op, condition=condition), customer=customer)
        rows.write.mode("append").parquet(feed)
        stream = changes.file_changes(spark, feed, files_per_batch=4)
        _finish(feeds.start(stream, feeds.upsert_batch(f"{root}/copy"), f"{root}/checkpoint"))
    return feeds.current(spark, f"{root}/copy").select("student_id", "op", "violation_cnt")


@query("c15_stream_split", f"""{with_views("f_change")} SELECT split_part(topic,'.',3) "table", kafka_offset, value FROM f_change""")
def stream_split(spark, sf_dir):
    feed = _feed(spark, table(spark, sf_dir, "f_change"), "split-feed")
    root = new_folder(spark, "split")
    stream = changes.file_changes(spark, feed, files_per_batch=4)
    # the other table of the feed is not listed
    _finish(feeds.start(stream, feeds.split_tables(f"{root}/copy", ("abc_warning",)), f"{root}/checkpoint"))
    listed = feeds.table_rows(spark, f"{root}/copy", "abc_warning").withColumn("table", F.lit("abc_warning"))
    rest = feeds.unrouted_rows(spark, f"{root}/copy")
    return listed.unionByName(rest, allowMissingColumns=True).select("table", "kafka_offset", "value")
