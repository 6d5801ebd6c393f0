"""Queries over the access-scoped question bank."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizgrove.operators import access, editing, organisation
from quizgrove.plans.fixtures import AS_OF, table, with_views
from quizgrove.plans.registry import query

WORDS = access.Words(
    approved="approved",
    pending="pending",
    rejected="rejected",
    active="active",
    super_admin="sysadmin",
    tenant_admin_roles=("principal", "admin"),
)
SUBJECTS = {"urgent_questions": "1-URGENT", "low_questions": "5-LOW"}
LISTING = access.AccessRules(as_of=AS_OF, words=WORDS)
LISTING_COMPAT = access.AccessRules(path_mode="compat", as_of=AS_OF, words=WORDS)
DETAIL = access.AccessRules(as_of=AS_OF, words=WORDS, enabled_only=False, check_expiry=False)
STATS = access.AccessRules(as_of=AS_OF, words=WORDS, check_expiry=False)
STATS_COMPAT = access.AccessRules(path_mode="compat", as_of=AS_OF, words=WORDS, check_expiry=False)

_COVERS = {
    "segment": """(q.org_path=m.org_path OR starts_with(q.org_path, m.org_path||'/')
    OR starts_with(m.org_path, q.org_path||'/'))""",
    "compat": """(starts_with(replace(q.org_path,'/',''), replace(m.org_path,'/',''))
    OR starts_with(replace(m.org_path,'/',''), replace(q.org_path,'/','')))""",
}
_LIVE = f"(expires_at IS NULL OR expires_at > date '{AS_OF}')"
_GRANTED = "(a.grantee_type='user' AND a.grantee_id=m.user_id) OR (a.grantee_type='org' AND a.grantee_id=m.org_id)"


def _scope_sql(mode: str, live: str = "true", enabled: str = "enabled=1") -> str:
    """CTEs: memberships m, questions q, approved grants, and every visible (user, question)."""
    return f"""{with_views("f_user", "f_user_org", "f_question", "f_acl")},
member AS (SELECT DISTINCT user_id, org_id, org_path FROM f_user_org WHERE {live}),
scoped AS (SELECT * FROM f_question WHERE {enabled}),
approved AS (SELECT * FROM f_acl WHERE review_status='approved' AND perm_level>=0),
visible AS (
 SELECT m.user_id, q.question_id FROM member m JOIN scoped q ON {_COVERS[mode]}
 UNION
 SELECT m.user_id, q.question_id FROM member m JOIN approved a ON a.grantee_type='user' AND a.grantee_id=m.user_id
  JOIN scoped q ON q.question_id=a.resource_id
 UNION
 SELECT m.user_id, q.question_id FROM member m JOIN approved a ON a.grantee_type='org' AND a.grantee_id=m.org_id
  JOIN scoped q ON q.question_id=a.resource_id)"""


def _stats_sql(mode: str) -> str:
    return f"""{_scope_sql(mode)},
counted AS (SELECT user_id, count(*) total, count(*) FILTER (subject='1-URGENT') urgent,
 count(*) FILTER (subject='5-LOW') low FROM visible JOIN scoped USING (question_id) GROUP BY user_id)
SELECT u.user_id,
 CAST(CASE WHEN user_type='sysadmin' THEN (SELECT count(*) FROM scoped) ELSE coalesce(total,0) END AS BIGINT) total_questions,
 CAST(CASE WHEN user_type='sysadmin' THEN (SELECT count(*) FROM scoped WHERE subject='1-URGENT')
  ELSE coalesce(urgent,0) END AS BIGINT) urgent_questions,
 CAST(CASE WHEN user_type='sysadmin' THEN (SELECT count(*) FROM scoped WHERE subject='5-LOW')
  ELSE coalesce(low,0) END AS BIGINT) low_questions
FROM f_user u LEFT JOIN counted c ON c.user_id=u.user_id"""


@query("x13_overview_stats", _stats_sql("segment"))
def overview_stats(spark, sf_dir):
    return access.overview_stats(
        table(spark, sf_dir, "f_user"), table(spark, sf_dir, "f_question"), table(spark, sf_dir, "f_user_org"),
        table(spark, sf_dir, "f_acl"), SUBJECTS, STATS,
    )


@query("x13_overview_stats_compat", _stats_sql("compat"))
def overview_stats_compat(spark, sf_dir):
    return access.overview_stats(
        table(spark, sf_dir, "f_user"), table(spark, sf_dir, "f_question"), table(spark, sf_dir, "f_user_org"),
        table(spark, sf_dir, "f_acl"), SUBJECTS, STATS_COMPAT,
    )


def _rows_sql(mode: str, wanted: str = "") -> str:
    return f"""{with_views("f_user", "f_user_org", "f_question", "f_acl")},
rows AS (SELECT DISTINCT m.user_id, q.question_id, q.created_at,
  CASE WHEN q.creator_id=m.user_id OR (a.perm_level>=1 AND ({_GRANTED})) THEN 1 ELSE 0 END can_edit
 FROM f_question q JOIN f_user_org m ON m.{_LIVE.strip("()").replace(" OR expires_at", " OR m.expires_at")}
 LEFT JOIN f_acl a ON a.resource_id=q.question_id AND a.perm_level>=0 AND a.review_status='approved'
 WHERE q.enabled=1{wanted} AND ({_COVERS[mode]} OR {_GRANTED})
  AND m.user_id IN (SELECT user_id FROM f_user WHERE user_type<>'sysadmin'))"""


def _page_sql(mode: str, raw: bool, wanted: str = "", places: str = "place<=20") -> str:
    source = "rows" if raw else "(SELECT user_id, question_id, created_at, max(can_edit) can_edit FROM rows GROUP BY ALL)"
    return f"""{_rows_sql(mode, wanted)}
SELECT user_id, question_id, CAST(created_at AS VARCHAR) created_at, can_edit, place FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, question_id, can_edit DESC) place
 FROM {source}) x WHERE {places}"""


def _page(spark, sf_dir, rules, raw=False, **listing):
    return access.visible_page(
        table(spark, sf_dir, "f_user"), table(spark, sf_dir, "f_question"), table(spark, sf_dir, "f_user_org"),
        table(spark, sf_dir, "f_acl"), rules, raw=raw, **listing,
    ).withColumn("created_at", F.col("created_at").cast("string"))


@query("x4_visible_list", _page_sql("segment", raw=False))
def visible_list(spark, sf_dir):
    return _page(spark, sf_dir, LISTING)


@query("x4_visible_list_raw", _page_sql("segment", raw=True))
def visible_list_raw(spark, sf_dir):
    return _page(spark, sf_dir, LISTING, raw=True)


@query("x4_visible_list_compat", _page_sql("compat", raw=True))
def visible_list_compat(spark, sf_dir):
    return _page(spark, sf_dir, LISTING_COMPAT, raw=True)


_WANTED = " AND q.subject='2-HIGH' AND q.grade='MACHINERY'"
_CRITERIA = {"subject": "2-HIGH", "grade": "MACHINERY", "difficulty": "", "no_such_column": 1}


@query("p4_visible_filtered_page", _page_sql("segment", raw=False, wanted=_WANTED, places="place BETWEEN 21 AND 40"))
def visible_filtered_page(spark, sf_dir):
    return _page(spark, sf_dir, LISTING, page=2, criteria=_CRITERIA)


@query(
    "a3_visible_total",
    f"""{_scope_sql("segment", _LIVE, "enabled=1" + _WANTED.replace("q.", ""))},
counted AS (SELECT user_id, count(*) n FROM visible GROUP BY user_id)
SELECT u.user_id, CAST(CASE WHEN user_type='sysadmin' THEN (SELECT count(*) FROM scoped) ELSE coalesce(n,0) END AS BIGINT) total_questions
FROM f_user u LEFT JOIN counted c ON c.user_id=u.user_id""",
)
def visible_total(spark, sf_dir):
    return access.visible_totals(
        table(spark, sf_dir, "f_user"), table(spark, sf_dir, "f_question"), table(spark, sf_dir, "f_user_org"),
        table(spark, sf_dir, "f_acl"), LISTING, _CRITERIA,
    )


@query(
    "x5_admin_list",
    f"""{with_views("f_question")}
SELECT question_id, subject, creator_id, org_path, CAST(created_at AS VARCHAR) created_at, 1 can_edit
FROM f_question q WHERE enabled=1 ORDER BY q.created_at DESC, question_id LIMIT 20""",
)
def admin_list(spark, sf_dir):
    return access.admin_page(table(spark, sf_dir, "f_question")).select(
        "question_id", "subject", "creator_id", "org_path", F.col("created_at").cast("string").alias("created_at"), "can_edit"
    )


@query(
    "p4_filtered_page",
    f"""{with_views("f_question")}
SELECT question_id, subject, grade, CAST(created_at AS VARCHAR) created_at, 1 can_edit
FROM f_question q WHERE enabled=1 AND subject='2-HIGH' AND grade='MACHINERY'
ORDER BY q.created_at DESC, question_id LIMIT 20 OFFSET 20""",
)
def filtered_page(spark, sf_dir):
    page = access.admin_page(table(spark, sf_dir, "f_question"), page=2, criteria=_CRITERIA)
    return page.select("question_id", "subject", "grade", F.col("created_at").cast("string").alias("created_at"), "can_edit")


@query(
    "x6_visibility_check",
    f"""{with_views("f_user", "f_user_org", "f_question", "f_acl", "f_pair", stored=True)},
super AS MATERIALIZED (SELECT user_id FROM f_user WHERE user_type='sysadmin'),
pair AS MATERIALIZED (SELECT p.user_id, p.question_id, q.org_path FROM f_pair p JOIN f_question q USING (question_id)),
member AS MATERIALIZED (SELECT DISTINCT user_id, org_id, org_path FROM f_user_org),
granted AS MATERIALIZED (SELECT DISTINCT resource_id, grantee_type, grantee_id FROM f_acl WHERE perm_level>=0 AND review_status='approved'),
hit AS MATERIALIZED (
 SELECT q.user_id, q.question_id FROM pair q JOIN member m ON m.user_id=q.user_id WHERE {_COVERS["segment"]}
 UNION SELECT q.user_id, q.question_id FROM pair q JOIN member m ON m.user_id=q.user_id
  JOIN granted a ON a.resource_id=q.question_id AND a.grantee_id=q.user_id WHERE a.grantee_type='user'
 UNION SELECT q.user_id, q.question_id FROM pair q JOIN member m ON m.user_id=q.user_id
  JOIN granted a ON a.resource_id=q.question_id AND a.grantee_id=m.org_id WHERE a.grantee_type='org'
 UNION SELECT q.user_id, q.question_id FROM pair q JOIN super u ON u.user_id=q.user_id)
SELECT p.user_id, p.question_id, h.user_id IS NOT NULL visible
FROM f_pair p LEFT JOIN hit h ON h.user_id=p.user_id AND h.question_id=p.question_id""",
)
def visibility_check(spark, sf_dir):
    return access.visibility_check(
        table(spark, sf_dir, "f_pair"), table(spark, sf_dir, "f_user"), table(spark, sf_dir, "f_question"),
        table(spark, sf_dir, "f_user_org"), table(spark, sf_dir, "f_acl"), DETAIL,
    )


def _edit_sql(approved_only: bool) -> str:
    review = " AND a.review_status='approved'" if approved_only else ""
    return f"""{with_views("f_user_org", "f_question", "f_acl", "f_pair")},
pair AS MATERIALIZED (SELECT p.user_id, p.question_id, q.creator_id FROM f_pair p JOIN f_question q USING (question_id)),
granted AS MATERIALIZED (SELECT DISTINCT a.resource_id, a.grantee_type, a.grantee_id FROM f_acl a WHERE a.perm_level>=1{review}),
member AS MATERIALIZED (SELECT DISTINCT user_id, org_id FROM f_user_org m WHERE {_LIVE}),
hit AS MATERIALIZED (SELECT user_id, question_id FROM pair WHERE creator_id=user_id
 UNION SELECT p.user_id, p.question_id FROM pair p JOIN granted a ON a.resource_id=p.question_id AND a.grantee_id=p.user_id
  WHERE a.grantee_type='user'
 UNION SELECT p.user_id, p.question_id FROM pair p JOIN member m ON m.user_id=p.user_id
  JOIN granted a ON a.resource_id=p.question_id AND a.grantee_id=m.org_id WHERE a.grantee_type='org')
SELECT p.user_id, p.question_id, h.user_id IS NOT NULL can_overwrite
FROM f_pair p LEFT JOIN hit h ON h.user_id=p.user_id AND h.question_id=p.question_id"""


@query("x7_edit_permission", _edit_sql(approved_only=True))
def edit_permission(spark, sf_dir):
    return access.edit_check(
        table(spark, sf_dir, "f_pair"), table(spark, sf_dir, "f_question"), table(spark, sf_dir, "f_user_org"),
        table(spark, sf_dir, "f_acl"), LISTING,
    )


@query("x7_edit_permission_compat", _edit_sql(approved_only=False))
def edit_permission_compat(spark, sf_dir):
    return access.edit_check(
        table(spark, sf_dir, "f_pair"), table(spark, sf_dir, "f_question"), table(spark, sf_dir, "f_user_org"),
        table(spark, sf_dir, "f_acl"), LISTING, require_approved=False,
    )


# --- lookups ---------------------------------------------------------------------------------


@query(
    "p1_active_user",
    f"""{with_views("f_user")}
SELECT user_id, username, real_name, user_type FROM f_user WHERE account_status='active'""",
)
def active_user(spark, sf_dir):
    users = table(spark, sf_dir, "f_user")
    return access.active_users(users, users.select("username"), WORDS)


@query(
    "p2_exists",
    f"""{with_views("f_pair", "f_question")}
SELECT DISTINCT p.user_id, p.question_id,
 EXISTS (SELECT 1 FROM f_question q WHERE q.question_id=p.question_id AND q.creator_id=p.user_id) is_owner FROM f_pair p""",
)
def exists(spark, sf_dir):
    owners = table(spark, sf_dir, "f_question").withColumnRenamed("creator_id", "user_id")
    return access.with_existence(table(spark, sf_dir, "f_pair"), owners, ["user_id", "question_id"], "is_owner")


@query(
    "p3_role_member",
    f"""{with_views("f_user_org", "f_role")}
SELECT user_id, bool_or(role_name IN ('principal','admin')) is_tenant_admin
FROM f_user_org JOIN f_role USING (role_id) GROUP BY user_id""",
)
def role_member(spark, sf_dir):
    return access.tenant_admins(table(spark, sf_dir, "f_user_org"), table(spark, sf_dir, "f_role"), WORDS)


@query(
    "p6_live_membership",
    f"""{with_views("f_user_org")}
SELECT DISTINCT user_id, org_id, org_path org_key FROM f_user_org WHERE {_LIVE}""",
)
def live_membership(spark, sf_dir):
    return access.memberships(table(spark, sf_dir, "f_user_org"), LISTING)


@query(
    "p13_pending",
    f"""{with_views("f_acl")}
SELECT acl_id, resource_id, grantee_id FROM f_acl WHERE review_status='pending'""",
)
def pending(spark, sf_dir):
    return access.pending_requests(table(spark, sf_dir, "f_acl"), WORDS).select("acl_id", "resource_id", "grantee_id")


@query(
    "j6_question_detail",
    f"""{with_views("f_question", "f_user")}
SELECT question_id, title, creator_id, real_name creator_name FROM f_question LEFT JOIN f_user ON user_id=creator_id""",
)
def detail(spark, sf_dir):
    rows = access.question_detail(table(spark, sf_dir, "f_question"), table(spark, sf_dir, "f_user"))
    return rows.select("question_id", "title", "creator_id", "creator_name")


@query(
    "x12_acl_names",
    f"""{with_views("f_acl", "f_user", "f_org")}
SELECT acl_id, resource_id, grantee_type, grantee_id, perm_level, review_status,
 coalesce(u.real_name, o.org_name, a.grantee_id) grantee_name
FROM f_acl a LEFT JOIN f_user u ON a.grantee_type='user' AND a.grantee_id=u.user_id
 LEFT JOIN f_org o ON a.grantee_type='org' AND a.grantee_id=o.org_id""",
)
def acl_names(spark, sf_dir):
    return access.permission_listing(
        table(spark, sf_dir, "f_acl"), table(spark, sf_dir, "f_user"), table(spark, sf_dir, "f_org")
    )


# --- organisation ----------------------------------------------------------------------------

_HOMES = f"""{with_views("f_user", "f_user_org", "f_org")},
placed AS (SELECT user_id, o.org_path, row_number() OVER (PARTITION BY user_id ORDER BY strlen(o.org_path), o.org_path) rn
 FROM f_user_org JOIN f_org o USING (org_id)),
homes AS (SELECT u.user_id, p.org_path home_path, coalesce(split_part(p.org_path,'/',1), concat('T',u.user_id)) tenant,
 split_part(p.org_path,'/',1) || '/' || nullif(split_part(p.org_path,'/',2),'') school
 FROM f_user u LEFT JOIN placed p ON p.user_id=u.user_id AND p.rn=1),
home AS (SELECT user_id, home_path, tenant,
 CASE WHEN EXISTS (SELECT 1 FROM f_org o WHERE o.org_path=school) THEN school ELSE tenant END default_path FROM homes)"""


def _homes(spark, sf_dir):
    return organisation.home_paths(
        table(spark, sf_dir, "f_user"), table(spark, sf_dir, "f_user_org"), table(spark, sf_dir, "f_org")
    )


@query("x1_tenant_prefix", f"{_HOMES} SELECT user_id, home_path, tenant FROM home")
def tenant_prefix(spark, sf_dir):
    return _homes(spark, sf_dir).select("user_id", "home_path", "tenant")


@query("x2_default_path", f"{_HOMES} SELECT user_id, default_path FROM home")
def default_path(spark, sf_dir):
    return _homes(spark, sf_dir).select("user_id", "default_path")


@query(
    "x3_missing_private_org",
    f"""{_HOMES},
wanted AS (SELECT user_id, tenant org_id, tenant org_path FROM home WHERE home_path IS NULL
 UNION ALL SELECT user_id, concat('PRV_',user_id), concat(tenant,'/PRIVATE/',user_id) FROM home)
SELECT 'org' kind, NULL user_id, org_id, org_path FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM f_org o WHERE o.org_id=w.org_id)
UNION ALL SELECT 'member', user_id, org_id, org_path FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM f_user_org m WHERE m.user_id=w.user_id AND m.org_id=w.org_id)""",
)
def missing_private_org(spark, sf_dir):
    org_rows, member_rows = organisation.missing_nodes(
        _homes(spark, sf_dir), table(spark, sf_dir, "f_user_org"), table(spark, sf_dir, "f_org")
    )
    nodes = org_rows.select(F.lit("org").alias("kind"), F.lit(None).cast("string").alias("user_id"), "org_id", "org_path")
    return nodes.unionByName(member_rows.withColumn("kind", F.lit("member")))


@query(
    "p7_org_subtree",
    f"""{_HOMES}
SELECT DISTINCT tenant, org_id, org_name, org_path FROM home JOIN f_org ON starts_with(replace(org_path,'/',''), tenant)""",
)
def org_subtree(spark, sf_dir):
    return organisation.tenant_tree(_homes(spark, sf_dir), table(spark, sf_dir, "f_org"))


# --- editing ---------------------------------------------------------------------------------

_CREATED = f"""{_HOMES.replace("WITH ", "WITH f_create AS (" + with_views("f_create").split("f_create AS (", 1)[1] + ", ", 1)},
made AS (SELECT concat('Q',request_id) question_id, c.user_id, title, coalesce(difficulty,'default') difficulty,
 CASE WHEN only_me THEN concat(coalesce(tenant, concat('T',c.user_id)),'/PRIVATE/',c.user_id)
  WHEN custom_path IN (SELECT org_path FROM f_org) THEN custom_path
  ELSE coalesce(default_path, concat('T',c.user_id)) END org_path
 FROM f_create c LEFT JOIN home h ON h.user_id=c.user_id)"""


def _created(spark, sf_dir):
    words = access.Words(default_difficulty="default")
    return editing.create_questions(
        table(spark, sf_dir, "f_create"), _homes(spark, sf_dir), table(spark, sf_dir, "f_org"), words
    )


@query("x8_create", f"{_CREATED} SELECT question_id, title, org_path, difficulty, user_id creator_id, 1 enabled FROM made")
def create(spark, sf_dir):
    return _created(spark, sf_dir)[0].select("question_id", "title", "org_path", "difficulty", "creator_id", "enabled")


@query(
    "x8_create_owner_grant",
    f"""{_CREATED} SELECT concat_ws('_','ACL',question_id,user_id) acl_id, question_id resource_id, 'user' grantee_type,
 user_id grantee_id, 2 perm_level FROM made""",
)
def create_owner_grant(spark, sf_dir):
    return _created(spark, sf_dir)[1].select("acl_id", "resource_id", "grantee_type", "grantee_id", "perm_level")


@query(
    "x9_fork_or_overwrite",
    f"""{with_views("f_user_org", "f_question", "f_acl", "f_edit")},
judged AS (SELECT e.*, q.creator_id owner, overwrite AND (q.creator_id=e.user_id OR EXISTS (SELECT 1 FROM f_acl a
  WHERE a.resource_id=e.question_id AND a.perm_level>=1 AND a.review_status='approved'
   AND ((a.grantee_type='user' AND a.grantee_id=e.user_id) OR (a.grantee_type='org' AND a.grantee_id IN
    (SELECT m.org_id FROM f_user_org m WHERE m.user_id=e.user_id AND {_LIVE}))))) in_place
 FROM f_edit e JOIN f_question q USING (question_id)),
last AS (SELECT question_id, arg_max(new_content, (length(CAST(edit_id AS VARCHAR)), CAST(edit_id AS VARCHAR))) new_content FROM judged WHERE in_place GROUP BY question_id)
SELECT 'row' kind, CAST(q.question_id AS VARCHAR) question_id, coalesce(new_content, content) content, creator_id, parent_id
FROM f_question q LEFT JOIN last USING (question_id)
UNION ALL SELECT 'fork', concat('Q',edit_id), new_content, user_id, question_id FROM judged WHERE NOT in_place""",
)
def fork_or_overwrite(spark, sf_dir):
    updated, forks, _ = editing.apply_edits(
        table(spark, sf_dir, "f_edit"), table(spark, sf_dir, "f_question"), table(spark, sf_dir, "f_user_org"),
        table(spark, sf_dir, "f_acl"), LISTING,
    )
    columns = [F.col("question_id").cast("string").alias("question_id"), "content", "creator_id", "parent_id"]
    return updated.select(F.lit("row").alias("kind"), *columns).unionByName(
        forks.select(F.lit("fork").alias("kind"), *columns)
    )


_ODD_EDITS = """SELECT edit_id, CASE WHEN question_id%4=1 THEN NULL ELSE user_id END user_id,
 CASE question_id%3 WHEN 1 THEN -question_id WHEN 2 THEN NULL ELSE question_id END question_id, new_content, overwrite FROM {edits}"""


@query(
    "x9_refused_edits",
    f"""{with_views("f_question", "f_edit")}, odd AS ({_ODD_EDITS.format(edits="f_edit")})
SELECT edit_id, o.user_id, o.question_id, CASE WHEN q.question_id IS NULL THEN 'unknown question' ELSE 'no user' END reason
FROM odd o LEFT JOIN f_question q ON q.question_id=o.question_id WHERE q.question_id IS NULL OR o.user_id IS NULL""",
)
def refused_edits(spark, sf_dir):
    edits = spark.sql(_ODD_EDITS, edits=table(spark, sf_dir, "f_edit"))
    refused = editing.apply_edits(
        edits, table(spark, sf_dir, "f_question"), table(spark, sf_dir, "f_user_org"), table(spark, sf_dir, "f_acl"), LISTING
    )[2]
    return refused.select("edit_id", "user_id", "question_id", "reason")


@query(
    "x10_request_edit",
    f"""{with_views("f_acl")}
SELECT concat_ws('_','REQ',l_orderkey,concat('U',l_suppkey)) acl_id, l_orderkey resource_id, concat('U',l_suppkey) grantee_id,
 1 perm_level, 'pending' review_status, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) requested_at
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM f_acl a WHERE a.resource_id=l_orderkey AND a.grantee_type='user'
 AND a.grantee_id=concat('U',l_suppkey) AND a.perm_level=1 AND a.review_status IN ('pending','approved'))
GROUP BY l_orderkey, l_suppkey""",
)
def request_edit(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("U"), "l_suppkey").alias("user_id"),
        F.col("l_orderkey").alias("question_id"),
        F.col("l_shipdate").cast("date").alias("requested_at"),
    )
    rows = editing.submit_requests(requests, table(spark, sf_dir, "f_acl"), WORDS)
    return rows.select(
        "acl_id", "resource_id", "grantee_id", "perm_level", "review_status", F.col("requested_at").cast("string")
    )


_DECISIONS = """SELECT acl_id, resource_id,
 CASE perm_level WHEN 0 THEN creator_id WHEN 1 THEN 'U50' ELSE grantee_id END approver_id,
 CASE WHEN grantee_type='user' THEN 'approve' WHEN perm_level=0 THEN 'ignore' ELSE 'reject' END action,
 date '2024-01-01' decided_at
FROM {acl} JOIN {question} ON question_id=resource_id WHERE review_status='pending'"""


@query(
    "x11_resolve",
    f"""{with_views("f_user", "f_question", "f_acl", stored=True)},
super AS MATERIALIZED (SELECT user_id FROM f_user WHERE user_type='sysadmin'),
decision AS MATERIALIZED ({_DECISIONS.format(acl="f_acl", question="f_question")}),
judged AS MATERIALIZED (SELECT d.*, q.creator_id FROM decision d JOIN f_question q ON q.question_id=d.resource_id
 WHERE d.action IN ('approve','reject')),
allowed AS MATERIALIZED (SELECT * FROM judged WHERE creator_id=approver_id
 UNION SELECT d.* FROM judged d JOIN super u ON u.user_id=d.approver_id)
SELECT a.acl_id, a.resource_id, a.grantee_id,
 CASE d.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE a.review_status END review_status,
 d.approver_id
FROM f_acl a LEFT JOIN allowed d ON d.acl_id=a.acl_id AND d.resource_id=a.resource_id""",
)
def resolve(spark, sf_dir):
    acl, question = table(spark, sf_dir, "f_acl"), table(spark, sf_dir, "f_question")
    decisions = spark.sql(_DECISIONS, acl=acl, question=question)
    rows = editing.resolve_requests(decisions, acl, question, table(spark, sf_dir, "f_user"), WORDS)
    return rows.select("acl_id", "resource_id", "grantee_id", "review_status", "approver_id")


@query(
    "x14_lineage",
    f"""{with_views("f_question").replace("WITH ", "WITH RECURSIVE ", 1)},
walk AS (SELECT question_id, question_id node, parent_id next, 0 depth FROM f_question
 UNION ALL SELECT w.question_id, w.next, q.parent_id, w.depth+1 FROM walk w LEFT JOIN f_question q ON q.question_id=w.next
 WHERE w.next IS NOT NULL)
SELECT question_id, node origin_id, depth FROM walk WHERE next IS NULL""",
)
def lineage(spark, sf_dir):
    return editing.fork_lineage(table(spark, sf_dir, "f_question"))
