"""Question-bank tables derived from the given star-schema tables.

Each view is one SQL text for both engines. ``{table}`` marks a base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

AS_OF = "2024-01-01"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "f_org": (
        ("region", "nation"),
        """SELECT concat('R', r_regionkey) org_id, r_name org_name, cast(r_regionkey AS string) org_path FROM {region}
UNION ALL
SELECT concat('N', n_nationkey), n_name, concat(n_regionkey, '/', n_nationkey) FROM {nation}""",
    ),
    "f_user": (
        ("customer",),
        """SELECT concat('U', c_custkey) user_id, c_name username, concat('Name ', c_custkey) real_name,
 CASE WHEN c_custkey%50=0 THEN 'sysadmin' ELSE lower(c_mktsegment) END user_type,
 CASE WHEN c_acctbal<0 THEN 'disabled' ELSE 'active' END account_status FROM {customer}""",
    ),
    "f_role": (
        ("region",),
        """SELECT r_regionkey role_id,
 CASE r_regionkey WHEN 0 THEN 'principal' WHEN 1 THEN 'admin' ELSE 'teacher' END role_name FROM {region}""",
    ),
    "f_user_org": (
        ("customer", "nation"),
        """SELECT concat('U', c_custkey) user_id,
 CASE WHEN c_custkey%10=0 THEN concat('R', n_regionkey) ELSE concat('N', n_nationkey) END org_id,
 CASE WHEN c_custkey%10=0 THEN cast(n_regionkey AS string) ELSE concat(n_regionkey, '/', n_nationkey) END org_path,
 cast(c_custkey%5 AS int) role_id,
 CASE WHEN c_custkey%7=0 THEN date '1999-01-01' END expires_at
FROM {customer} JOIN {nation} ON c_nationkey=n_nationkey
UNION ALL
SELECT concat('U', c_custkey), concat('N', c_custkey%25), concat(n_regionkey, '/', n_nationkey), 4, NULL
FROM {customer} JOIN {nation} ON n_nationkey=c_custkey%25 WHERE c_mktsegment='BUILDING'""",
    ),
    "f_question": (
        ("orders", "customer", "nation"),
        """SELECT o_orderkey question_id, concat('Title ', o_orderkey) title,
 concat('Content ', o_orderkey) content, o_orderstatus type, o_orderpriority subject,
 c_mktsegment grade, concat('U', o_custkey) creator_id,
 concat(n_regionkey, '/', n_nationkey) org_path, CASE WHEN o_orderstatus='P' THEN 0 ELSE 1 END enabled,
 cast(o_orderdate AS date) created_at,
 CASE WHEN o_orderkey%10>0 THEN o_orderkey-1 END parent_id
FROM {orders} JOIN {customer} ON o_custkey=c_custkey JOIN {nation} ON c_nationkey=n_nationkey""",
    ),
    "f_acl": (
        ("lineitem",),
        """SELECT concat_ws('_', 'ACL', resource_id, grantee_id, perm_level, review_status) acl_id, *
FROM (SELECT DISTINCT l_orderkey resource_id,
 CASE WHEN l_linestatus='F' THEN 'user' ELSE 'org' END grantee_type,
 CASE WHEN l_linestatus='F' THEN concat('U', l_suppkey) ELSE concat('N', l_suppkey%25) END grantee_id,
 cast(l_linenumber%3 AS int) perm_level,
 CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending' END review_status
FROM {lineitem}) grants""",
    ),
    "f_pair": (
        ("lineitem",),
        """SELECT concat('U', l_partkey) user_id, l_orderkey question_id FROM {lineitem}
UNION
SELECT concat('U', l_suppkey), l_orderkey FROM {lineitem}""",
    ),
    "f_create": (
        ("orders",),
        """SELECT o_orderkey request_id, concat('U', o_custkey) user_id, concat('New ', o_orderkey) title,
 o_orderpriority content, o_orderstatus type, o_orderpriority subject, o_orderstatus grade,
 CASE WHEN o_orderpriority='1-URGENT' THEN 'hard' END difficulty, o_orderstatus='P' only_me,
 concat(o_custkey%5, '/', o_orderkey%25) custom_path FROM {orders}""",
    ),
    "f_edit": (
        ("lineitem",),
        """SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_suppkey) edit_id, concat('U', l_suppkey) user_id,
 l_orderkey question_id, concat('edited ', l_linenumber, ' by ', l_suppkey) new_content,
 l_linenumber%2=0 overwrite FROM {lineitem}""",
    ),
    "f_warning": (
        ("events",),
        """SELECT cast(ts AS date) snapshot_date, concat('S', user_id) student_id,
 round(1-cast(sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS double)/count(*),4) attendance_rate,
 round(cast(sum(CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END) AS double)/count(*),4) submit_rate,
 cast(sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS int) violation_cnt,
 cast(sum(CASE WHEN value<5 THEN 1 ELSE 0 END) AS int) core_fail_cnt,
 CASE WHEN sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END)>=2 THEN 'high'
      WHEN sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END)=1 THEN 'mid' ELSE 'low' END risk_level
FROM {events} GROUP BY cast(ts AS date), user_id""",
    ),
    "f_change": (
        ("events",),
        """SELECT event_id kafka_offset,
 concat('srv.src.', CASE WHEN event_id%10=0 THEN 'other' ELSE 'abc_warning' END) topic,
 CASE WHEN event_id%251=7 THEN '{{bad' ELSE concat('{{"snapshot_date":', cast(19723+event_id%3 AS string),
  ',"student_id":"S', cast(user_id AS string), '","attendance_rate":"0.', lpad(cast(event_id%10000 AS string),4,'0'),
  '","violation_cnt":', cast(event_id%11 AS string), ',"risk_level":"',
  CASE event_id%3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END, '","__op":"',
  CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' WHEN 'error' THEN 'd' ELSE 'u' END,
  '","__ts_ms":', cast(1704067200000+(event_id*7919%100003)*1000 AS string), '}}') END value
FROM {events}""",
    ),
    "f_item": (
        ("embeddings", "documents"),
        """SELECT vec_id question_id, embedding, cast(label%4+1 AS int) type_id, cast(17+label%3 AS int) subject_id,
 cast(1+vec_id%3 AS int) grade_id, cast(1+vec_id%5 AS int) difficulty_id, text content,
 CASE WHEN label%4<2 THEN concat('A. ', label, ' B. ', label+1) ELSE '' END options
FROM {embeddings} LEFT JOIN {documents} ON doc_id=vec_id""",
    ),
    "f_attempt": (
        ("lineitem", "orders", "part"),
        """SELECT o_custkey learner_id, l_suppkey teacher_id, l_partkey question_id, p_brand topic, p_type question_type,
 p_size difficulty, cast(l_shipdate AS date) AS day, CASE WHEN l_returnflag='R' THEN 0 ELSE 1 END correct,
 CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END self_rating, l_extendedprice score, l_discount gain
FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey JOIN {part} ON l_partkey=p_partkey""",
    ),
    "f_source": (
        ("orders",),
        """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate AS date) snapshot_date
FROM {orders}""",
    ),
    "f_target": (
        ("orders",),
        """SELECT o_orderkey, o_custkey, o_orderstatus,
 CASE WHEN o_orderpriority='1-URGENT' THEN o_totalprice+1 ELSE o_totalprice END o_totalprice,
 cast(o_orderdate AS date) snapshot_date
FROM {orders} WHERE o_orderstatus<>'P' AND cast(o_orderdate AS date)<=date '2001-06-30'""",
    ),
}

# The outside recommendation list: ids that follow an item within 20 places and share its label.
_EXTERNAL = """SELECT a.vec_id query_id, b.vec_id ext_id
FROM (SELECT vec_id, label, {numbers} step FROM {embeddings}) a
JOIN {embeddings} b ON b.vec_id=a.vec_id+a.step AND b.label=a.label"""
_NUMBERS = {"spark": "explode(sequence(1,20))", "duckdb": "unnest(range(1,21))"}


_schemas: dict[str, StructType] = {}


def _base(spark: SparkSession, path: str) -> DataFrame:
    if path in _schemas:
        return spark.read.schema(_schemas[path]).parquet(path)
    df = spark.read.parquet(path)
    _schemas[path] = df.schema
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    if name in BASE:
        return _base(spark, f"{sf_dir}/{name}.parquet")
    if name == "f_external":
        embeddings = table(spark, sf_dir, "embeddings")
        text = _EXTERNAL.replace("{numbers}", _NUMBERS["spark"])
        return spark.sql(text, embeddings=embeddings)
    needs, text = VIEWS[name]
    return spark.sql(text, **{base: table(spark, sf_dir, base) for base in needs})


def with_views(*names: str, stored: bool = False) -> str:
    """``WITH`` clause that defines the views for the SQL side; ``stored``: each is worked out once."""
    parts = []
    for name in names:
        if name == "f_external":
            text = _EXTERNAL.replace("{numbers}", _NUMBERS["duckdb"]).replace("{embeddings}", "embeddings")
        else:
            needs, template = VIEWS[name]
            text = template.format(**{base: base for base in needs})
        parts.append(f"{name} AS {'MATERIALIZED ' if stored else ''}({text})")
    return "WITH " + ",\n".join(parts)
