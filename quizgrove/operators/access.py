"""Who may see or edit which question, for all users in one job.

A question is visible through a live membership when the organisation paths cover one another, or
through an approved grant to the user or to one of the user's organisations.

Nothing here builds the user x question pairs. Users with the same memberships form one *class*;
paths are compared as equi-joins on exploded ancestors; counts and newest-first pages are reduced
per path, per organisation and per class before they meet a user.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizgrove.functions import paths
from quizgrove.session import saved


@dataclass(frozen=True)
class Words:
    """Fixed values of the source tables' status columns."""

    approved: str = "已通过"
    pending: str = "待审核"
    rejected: str = "已拒绝"
    active: str = "正常"
    super_admin: str = "系统管理员"
    tenant_admin_roles: tuple[str, ...] = ("校长", "管理员")
    request_open: str = "待审批"
    request_none: str = "无需申请"
    default_difficulty: str = "中等"
    resource_type: str = "题目"
    own_kind: str = "所有权"
    own_source: str = "作者"
    edit_kind: str = "编辑"
    edit_source: str = "申请获得"


@dataclass(frozen=True)
class AccessRules:
    """How scope is decided. ``as_of`` is a date or timestamp literal; None means now."""

    path_mode: str = "segment"
    as_of: str | None = None
    enabled_only: bool = True
    check_expiry: bool = True
    words: Words = Words()

    def now(self) -> Column:
        return F.current_timestamp() if self.as_of is None else F.lit(self.as_of).cast("timestamp")


# --- lookups ---------------------------------------------------------------------------------


def active_users(users: DataFrame, usernames: DataFrame, words: Words = Words()) -> DataFrame:
    """Users with one of the given names whose account is active."""
    return (
        users.filter(F.col("account_status") == words.active)
        .join(usernames.select("username").distinct(), "username", "left_semi")
        .select("user_id", "username", "real_name", "user_type")
    )


def with_existence(keys: DataFrame, table: DataFrame, on: Sequence[str], name: str = "found") -> DataFrame:
    """Adds a flag: does a row with this key exist in ``table``."""
    on = list(on)
    hits = table.select(*on).distinct().withColumn(name, F.lit(True))
    return keys.join(hits, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def tenant_admins(user_org: DataFrame, roles: DataFrame, words: Words = Words()) -> DataFrame:
    """One row per user with memberships: holds an administrative role or not."""
    named = user_org.select("user_id", "role_id").join(roles.select("role_id", "role_name"), "role_id")
    return named.groupBy("user_id").agg(
        F.max(F.col("role_name").isin(*words.tenant_admin_roles)).alias("is_tenant_admin")
    )


def matching(df: DataFrame, criteria: Mapping[str, object]) -> DataFrame:
    """Equality on each named column; an empty value or an unknown column adds no condition."""
    for name, value in criteria.items():
        if name in df.columns and value not in (None, ""):
            df = df.filter(F.col(name) == F.lit(value))
    return df


def memberships(user_org: DataFrame, rules: AccessRules) -> DataFrame:
    """Distinct memberships that count, with their comparable path."""
    if rules.check_expiry:
        user_org = user_org.filter(F.col("expires_at").isNull() | (F.col("expires_at") > rules.now()))
    return user_org.select(
        "user_id", "org_id", paths.path_key(F.col("org_path"), rules.path_mode).alias("org_key")
    ).distinct()


def questions_in_scope(question: DataFrame, rules: AccessRules, columns: Sequence[str] = ()) -> DataFrame:
    if rules.enabled_only:
        question = question.filter(F.col("enabled") == 1)
    key = paths.path_key(F.col("org_path"), rules.path_mode).alias("q_key")
    return question.select("question_id", key, *columns)


def approved_grants(acl: DataFrame, words: Words) -> DataFrame:
    """Grants per (question, grantee): how many allow editing, how many only viewing."""
    return (
        acl.filter((F.col("review_status") == words.approved) & (F.col("perm_level") >= 0))
        .groupBy(F.col("resource_id").alias("question_id"), "grantee_type", "grantee_id")
        .agg(
            F.count_if(F.col("perm_level") >= 1).alias("n_edit"),
            F.count_if(F.col("perm_level") < 1).alias("n_view"),
        )
    )


# --- membership classes ----------------------------------------------------------------------


@dataclass(frozen=True)
class Classes:
    """Users grouped by identical membership sets; the number of classes follows the organisation tree."""

    users: DataFrame  # user_id, class_id
    members: DataFrame  # class_id, org_id, org_key


def _digest(*columns: str) -> Column:
    """A short key that stands for the exact values of the columns."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def membership_classes(live: DataFrame) -> Classes:
    # The set per user is bounded by the number of organisations, not by the rows of the table.
    members = F.sort_array(F.collect_set(F.struct("org_id", "org_key")))
    per_user = saved(
        live.groupBy("user_id").agg(members.alias("members")).withColumn("class_id", _digest("members")), "user-classes"
    )
    classes = per_user.groupBy("class_id").agg(F.any_value("members").alias("members"))
    return Classes(
        users=per_user.select("user_id", "class_id"),
        members=saved(classes.select("class_id", F.inline("members")), "class-members"),
    )


def _class_paths(classes: Classes) -> DataFrame:
    return classes.members.filter(F.col("org_key").isNotNull()).select("class_id", "org_key").distinct()


def _ancestors(class_paths: DataFrame, mode: str) -> DataFrame:
    return class_paths.select(
        "class_id", "org_key", F.explode(paths.strict_prefixes(F.col("org_key"), mode)).alias("node")
    )


def _disjoint_cover(classes: Classes, mode: str) -> tuple[DataFrame, DataFrame]:
    """Topmost paths of each class (their subtrees do not overlap) and the nodes strictly above them."""
    own = _class_paths(classes)
    above = _ancestors(own, mode)
    inner = above.join(own.select("class_id", F.col("org_key").alias("node")), ["class_id", "node"], "left_semi")
    tops = own.join(inner.select("class_id", "org_key").distinct(), ["class_id", "org_key"], "left_anti")
    uppers = _ancestors(tops, mode).select("class_id", "node").distinct()
    return tops.withColumnRenamed("org_key", "node"), uppers


def path_visible(candidates: DataFrame, classes: Classes, mode: str) -> DataFrame:
    """Of the (class_id, q_key) candidates, those visible through a path."""
    wanted = candidates.select("class_id", "q_key").filter(F.col("q_key").isNotNull()).distinct()
    own = _class_paths(classes)
    below = (
        wanted.select("class_id", "q_key", F.explode(paths.prefixes(F.col("q_key"), mode)).alias("org_key"))
        .join(own, ["class_id", "org_key"], "left_semi")
        .select("class_id", "q_key")
    )
    above = wanted.join(
        _ancestors(own, mode).select("class_id", F.col("node").alias("q_key")), ["class_id", "q_key"], "left_semi"
    )
    return below.union(above).distinct()


def _org_grants(grants: DataFrame) -> DataFrame:
    return grants.filter(F.col("grantee_type") == "org").select("question_id", F.col("grantee_id").alias("org_id"))


def _user_grants(grants: DataFrame) -> DataFrame:
    return grants.filter(F.col("grantee_type") == "user").select("question_id", F.col("grantee_id").alias("user_id"))


# --- overview counts -------------------------------------------------------------------------

def _sums(names: Sequence[str]) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def _granted_counts(
    granted: DataFrame, members: DataFrame, tops: DataFrame, uppers: DataFrame,
    measures: Sequence[Column], counts: Sequence[str], mode: str,
) -> DataFrame:
    """Per class: questions granted to each of its organisations and not visible by path.

    A question granted to several organisations of a class counts once for each of them. Counts per
    (organisation, path) and per subtree stand in for the questions, so no question meets a class.
    """
    cells = granted.groupBy("org_id", "q_key").agg(*measures)
    totals = cells.groupBy("org_id").agg(*_sums(counts))
    keyed = cells.filter(F.col("q_key").isNotNull())
    subtrees = (
        keyed.select("org_id", F.explode(paths.prefixes(F.col("q_key"), mode)).alias("node"), *counts)
        .groupBy("org_id", "node")
        .agg(*_sums(counts))
    )
    below = members.join(tops, "class_id").join(subtrees, ["org_id", "node"])
    above = members.join(uppers, "class_id").join(keyed.withColumnRenamed("q_key", "node"), ["org_id", "node"])
    visible = below.select("class_id", *counts).union(above.select("class_id", *counts))
    minus = visible.select("class_id", *[(-F.col(name)).alias(name) for name in counts])
    return members.join(totals, "org_id").select("class_id", *counts).union(minus)


def _grant_words(org_grants: DataFrame, q: DataFrame) -> DataFrame:
    """Questions granted to two or more organisations, as bits: org_id, q_key, subject, word and its 64 bits.

    Questions are numbered in order of path and subject, so that an organisation's questions of one kind share
    words. The numbers come from a sort by ranges: no path's questions meet in one task.
    """
    several = org_grants.groupBy("question_id").agg(F.count("*").alias("grants")).filter(F.col("grants") > 1)
    order = ["q_key", "subject", "question_id"]
    rows = q.join(several, "question_id", "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = saved(rows.select(*order, F.monotonically_increasing_id().alias("number")), "granted-questions")
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(number & 63 AS INT))")).alias("bits")
    words = org_grants.join(numbered, "question_id").withColumn("word", F.shiftright("number", 6))
    return saved(words.groupBy("org_id", "q_key", "subject", "word").agg(bits), "grant-words")


def _repeated_grants(org_grants: DataFrame, q: DataFrame, members: DataFrame, subjects: Mapping[str, str]) -> DataFrame:
    """Per class and path: how often its questions were counted more than once, in total and per subject.

    An organisation's questions are bitmaps; those of a class's organisations are or-ed word by word. What the
    single bitmaps count more than their union was counted again. Rows follow classes and words, whatever
    the number of organisations that share a question, and are added up in each task before they are shuffled.
    """
    sharing = members.groupBy("class_id").agg(F.count("*").alias("orgs")).filter(F.col("orgs") > 1)
    words = members.join(sharing, "class_id", "left_semi").join(_grant_words(org_grants, q), "org_id")
    union = words.groupBy("class_id", "q_key", "subject", "word").agg(F.bit_or("bits").alias("any_org"), F.sum(F.bit_count("bits")).alias("each_org"))
    again = F.col("each_org") - F.bit_count("any_org")
    of_subject = [F.sum(F.when(F.col("subject") == value, again).otherwise(0)).alias(name) for name, value in subjects.items()]
    counts = union.groupBy("class_id", "q_key").agg(F.sum(again).alias("total_questions"), *of_subject)
    return saved(counts.filter(F.col("total_questions") > 0), "repeated-grants")


def overview_stats(
    users: DataFrame,
    question: DataFrame,
    user_org: DataFrame,
    acl: DataFrame,
    subjects: Mapping[str, str],
    rules: AccessRules = AccessRules(check_expiry=False),
) -> DataFrame:
    """Distinct visible questions per user: in total and per named subject.

    ``subjects`` maps an output column to a subject value. Super administrators see every enabled
    question. Other users without a membership see none.
    """
    counts = ["total_questions", *subjects]
    mode = rules.path_mode
    q = questions_in_scope(question, rules, ["subject"])
    measures = [F.count("*").alias("total_questions")] + [
        F.count_if(F.col("subject") == value).alias(name) for name, value in subjects.items()
    ]

    per_path = q.filter(F.col("q_key").isNotNull()).groupBy("q_key").agg(*measures)
    per_subtree = (
        per_path.select(F.explode(paths.prefixes(F.col("q_key"), mode)).alias("node"), *counts)
        .groupBy("node")
        .agg(*_sums(counts))
    )
    classes = membership_classes(memberships(user_org, rules))
    tops, uppers = _disjoint_cover(classes, mode)
    by_path = (
        tops.join(per_subtree, "node")
        .unionByName(uppers.join(per_path.withColumnRenamed("q_key", "node"), "node"))
        .groupBy("class_id")
        .agg(*_sums(counts))
    )

    grants = approved_grants(acl, rules.words)
    members = classes.members.select("class_id", "org_id").distinct()
    by_grant = _granted_counts(_org_grants(grants).join(q, "question_id"), members, tops, uppers, measures, counts, mode)
    repeats = _repeated_grants(_org_grants(grants), q, members, subjects)
    to_user = saved(_user_grants(grants).join(q, "question_id").join(classes.users, "user_id"), "user-granted")
    candidates = repeats.select("class_id", "q_key").union(to_user.select("class_id", "q_key"))
    reached = saved(path_visible(candidates, classes, mode), "path-visible")
    extra_org = by_grant.unionByName(
        repeats.join(reached, ["class_id", "q_key"], "left_anti").select(
            "class_id", *[(-F.col(name)).alias(name) for name in counts]
        )
    )
    also_by_org = (
        to_user.select("user_id", "class_id", "question_id").join(members, "class_id")
        .join(_org_grants(grants), ["question_id", "org_id"], "left_semi")
        .select("user_id", "question_id")
    )
    extra_user = to_user.join(reached, ["class_id", "q_key"], "left_anti").join(
        also_by_org, ["user_id", "question_id"], "left_anti"
    )

    per_class = by_path.unionByName(extra_org).groupBy("class_id").agg(*_sums(counts))
    per_user = (
        classes.users.join(per_class, "class_id")
        .select("user_id", *counts)
        .unionByName(extra_user.groupBy("user_id").agg(*measures))
        .groupBy("user_id")
        .agg(*_sums(counts))
    )
    everything = q.agg(*measures)
    is_super = F.col("user_type") == rules.words.super_admin
    return (
        users.select("user_id", "user_type")
        .join(per_user, "user_id", "left")
        .select(
            "user_id",
            *[
                F.when(is_super, everything.select(name).scalar()).otherwise(F.coalesce(name, F.lit(0))).alias(name)
                for name in counts
            ],
        )
    )


def visible_totals(
    users: DataFrame,
    question: DataFrame,
    user_org: DataFrame,
    acl: DataFrame,
    rules: AccessRules = AccessRules(),
    criteria: Mapping[str, object] | None = None,
) -> DataFrame:
    """Length of every user's list under the criteria of a listing, as ``total_questions`` (A3).

    A question counts once, however many grants reach it. Super administrators see every enabled question.
    """
    return overview_stats(users, matching(question, criteria or {}), user_org, acl, {}, rules)


# --- listing ---------------------------------------------------------------------------------

LISTED_ROWS = 500_000  # made by a task


def _by_age() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("question_id").asc()]


def _newest(df: DataFrame, key: str, count: int) -> DataFrame:
    """The newest ``count`` questions per key. Spark cuts each task's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*_by_age()))
    return df.withColumn("place", place).filter(F.col("place") <= count).drop("place")


def _younger(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as ``_by_age`` puts the struct ``a`` before ``b``, beside or behind it."""
    a_day, b_day, a_id, b_id = a["created_at"], b["created_at"], a["question_id"], b["question_id"]
    by_id = F.when(a_id.eqNullSafe(b_id), 0).when(a_id.isNull(), -1).when(b_id.isNull(), 1).when(a_id < b_id, -1).otherwise(1)
    by_day = F.when(a_day.isNull(), 1).when(b_day.isNull(), -1).when(a_day > b_day, -1).otherwise(1)
    return F.when(a_day.eqNullSafe(b_day), by_id).otherwise(by_day)


def _listed(users: DataFrame, per_class: DataFrame, own: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` questions of each user, of those of the user's class and the user's own.

    Both lists hold ``count`` questions at most and meet as one array per user; rows are made of it only after
    the users are dealt out, so that a task makes about ``LISTED_ROWS`` of them, however many users there are.
    """
    rows = F.collect_list(F.struct("question_id", "created_at"))
    lists = users.join(own.groupBy("user_id").agg(rows.alias("of_user")), "user_id", "left")
    lists = lists.join(per_class.groupBy("class_id").agg(rows.alias("of_class")), "class_id", "left")
    both = F.when(F.col("of_class").isNull(), F.col("of_user")).otherwise(F.concat("of_user", "of_class"))
    newest = F.slice(F.array_sort(F.array_distinct(both), _younger), 1, count)
    listed = F.when(F.col("of_user").isNull(), F.col("of_class")).otherwise(newest)
    # by a hash of its own, or Spark leaves it out where the users already lie by id
    tasks = max(1, -(-users.count() * count // LISTED_ROWS))
    return lists.select("user_id", listed.alias("listed")).repartition(tasks, F.xxhash64("user_id")).select("user_id", F.inline("listed"))


def visible_page(
    users: DataFrame,
    question: DataFrame,
    user_org: DataFrame,
    acl: DataFrame,
    rules: AccessRules = AccessRules(),
    page: int = 1,
    limit: int = 20,
    criteria: Mapping[str, object] | None = None,
    raw: bool = False,
) -> DataFrame:
    """One page of the newest visible questions for every user, with ``can_edit``.

    ``raw=True`` keeps the duplicate a question gets when some of its grant rows allow editing and
    others do not (U2); the page is then cut over those rows.
    """
    mode, need = rules.path_mode, page * limit
    q = questions_in_scope(matching(question, criteria or {}), rules, ["created_at"])
    live = memberships(user_org, rules)
    scoped_users = users.filter(
        F.col("user_type").isNull() | (F.col("user_type") != rules.words.super_admin)
    ).select("user_id")
    live = live.join(scoped_users, "user_id", "left_semi")
    classes = membership_classes(live)
    tops, uppers = _disjoint_cover(classes, mode)
    grants = approved_grants(acl, rules.words)

    columns = ["question_id", "created_at"]
    per_path = _newest(q.filter(F.col("q_key").isNotNull()), "q_key", need)
    per_subtree = _newest(
        per_path.select(F.explode(paths.prefixes(F.col("q_key"), mode)).alias("node"), *columns), "node", need
    )
    per_org = _newest(_org_grants(grants).join(q, "question_id"), "org_id", need)
    per_class = _newest(
        tops.join(per_subtree, "node").select("class_id", *columns)
        .union(uppers.join(per_path, uppers.node == per_path.q_key).select("class_id", *columns))
        .union(classes.members.join(per_org, "org_id").select("class_id", *columns))
        .distinct(),
        "class_id",
        need,
    )
    own = _newest(
        _user_grants(grants).join(classes.users, "user_id", "left_semi").join(q, "question_id"), "user_id", need
    )
    listed = _listed(classes.users, per_class.select("class_id", *columns), own.select("user_id", *columns), need)
    flags = _edit_flags(listed, question, live, grants, mode)
    order = Window.partitionBy("user_id").orderBy(*_by_age(), F.col("can_edit").desc())
    if raw:
        listed = flags.select(
            "user_id",
            "question_id",
            "created_at",
            F.explode(F.filter(F.array(F.when(F.col("some_edit"), 1), F.when(F.col("some_view"), 0)), F.isnotnull))
            .alias("can_edit"),
        )
    else:
        listed = flags.withColumn("can_edit", F.when(F.col("some_edit"), 1).otherwise(0))
    place = F.row_number().over(order)
    return (
        listed.withColumn("place", place)
        .filter(F.col("place").between(need - limit + 1, need))
        .select("user_id", "question_id", "created_at", "can_edit", "place")
    )


def _edit_flags(pairs: DataFrame, question: DataFrame, live: DataFrame, grants: DataFrame, mode: str) -> DataFrame:
    """For visible (user, question) pairs: does some / does not some grant row allow editing."""
    columns = question.select(
        "question_id", "creator_id", paths.path_key(F.col("org_path"), mode).alias("q_key")
    )
    held = grants.groupBy("question_id").agg(F.sum(F.col("n_edit") + F.col("n_view")).alias("n_rows"))
    to_user = grants.filter(F.col("grantee_type") == "user").select(
        "question_id", F.col("grantee_id").alias("user_id"), F.col("n_edit").alias("u_edit"), F.col("n_view").alias("u_view")
    )
    to_org = grants.filter(F.col("grantee_type") == "org").select(
        "question_id", F.col("grantee_id").alias("org_id"), F.col("n_edit").alias("o_edit"), F.col("n_view").alias("o_view")
    )
    rows = (
        pairs.join(columns, "question_id")
        .join(held, "question_id", "left")
        .join(to_user, ["question_id", "user_id"], "left")
        .join(live, "user_id")
        .join(to_org, ["question_id", "org_id"], "left")
        .fillna(0, ["n_rows", "u_edit", "u_view", "o_edit", "o_view"])
    )
    by_creator = F.col("creator_id") == F.col("user_id")
    edit_rows = F.col("u_edit") + F.col("o_edit")
    by_path = F.coalesce(
        paths.covers(F.col("org_key"), F.col("q_key"), mode) | paths.covers(F.col("q_key"), F.col("org_key"), mode),
        F.lit(False),
    )
    plain = (by_path & ((F.col("n_rows") == 0) | (F.col("n_rows") > edit_rows))) | (F.col("u_view") + F.col("o_view") > 0)
    return rows.groupBy("user_id", "question_id", "created_at").agg(
        F.max(F.coalesce(by_creator, F.lit(False)) | (edit_rows > 0)).alias("some_edit"),
        F.max(~F.coalesce(by_creator, F.lit(False)) & plain).alias("some_view"),
    )


def admin_page(
    question: DataFrame, page: int = 1, limit: int = 20, criteria: Mapping[str, object] | None = None
) -> DataFrame:
    """The super administrator's page: every enabled question, always editable."""
    rows = matching(question, criteria or {}).filter(F.col("enabled") == 1).withColumn("can_edit", F.lit(1))
    return rows.orderBy(*_by_age()).offset((page - 1) * limit).limit(limit)


# --- checks on given pairs -------------------------------------------------------------------


def visibility_check(
    pairs: DataFrame,
    users: DataFrame,
    question: DataFrame,
    user_org: DataFrame,
    acl: DataFrame,
    rules: AccessRules = AccessRules(enabled_only=False, check_expiry=False),
) -> DataFrame:
    """For each distinct (user, question) pair: may the user see it (X6, J9). Work grows with the pairs."""
    pairs = pairs.select("user_id", "question_id").distinct()
    live = memberships(user_org, rules)
    classes = membership_classes(live)
    grants = approved_grants(acl, rules.words)
    in_scope = F.coalesce(F.col("enabled") == 1, F.lit(False)) if rules.enabled_only else F.lit(True)
    about = question.select(
        "question_id", paths.path_key(F.col("org_path"), rules.path_mode).alias("q_key"), in_scope.alias("in_scope")
    )
    supers = users.filter(F.col("user_type") == rules.words.super_admin).select("user_id", F.lit(True).alias("is_super"))
    # every pair stays in one table and gains flags, so that pairs are shuffled once for each kind of grant
    known = saved(
        pairs.join(about, "question_id", "left")
        .join(classes.users, "user_id", "left").join(supers.distinct(), "user_id", "left"),
        "asked-pairs",
    )
    asked = known.filter(F.col("in_scope") & F.col("class_id").isNotNull())
    wanted = saved(asked.select("class_id", "q_key").distinct(), "asked-paths")
    reached = path_visible(wanted, classes, rules.path_mode).withColumn("by_path", F.lit(True))
    by_user = _user_grants(grants).withColumn("by_user", F.lit(True))
    by_org = (
        asked.select("class_id", "question_id").distinct()
        .join(classes.members.select("class_id", "org_id"), "class_id")
        .join(_org_grants(grants), ["question_id", "org_id"], "left_semi")
        .select("class_id", "question_id").distinct().withColumn("by_org", F.lit(True))
    )
    granted = F.col("in_scope") & F.col("class_id").isNotNull() & F.coalesce("by_path", "by_user", "by_org", F.lit(False))
    by_role = F.col("in_scope").isNotNull() & F.col("is_super")
    return (
        known.join(reached, ["class_id", "q_key"], "left")
        .join(by_org, ["class_id", "question_id"], "left")
        .join(by_user, ["user_id", "question_id"], "left")
        .groupBy("user_id", "question_id")
        .agg(F.max(F.coalesce(granted, F.lit(False)) | F.coalesce(by_role, F.lit(False))).alias("visible"))
    )


def edit_check(
    pairs: DataFrame,
    question: DataFrame,
    user_org: DataFrame,
    acl: DataFrame,
    rules: AccessRules = AccessRules(),
    require_approved: bool = True,
) -> DataFrame:
    """For each distinct (user, question) pair: may the user overwrite it.

    ``require_approved=False`` lets a pending grant count as well.
    """
    pairs = pairs.select("user_id", "question_id").distinct()
    held = acl.filter(F.col("perm_level") >= 1).withColumnRenamed("resource_id", "question_id")
    if require_approved:
        held = held.filter(F.col("review_status") == rules.words.approved)
    classes = membership_classes(memberships(user_org, rules))
    known = pairs.join(question.select("question_id", "creator_id"), "question_id")
    asked = saved(known.join(classes.users, "user_id", "left"), "asked-edits")
    own = asked.filter(F.col("creator_id") == F.col("user_id")).select("user_id", "question_id")
    by_user = asked.select("user_id", "question_id").join(_user_grants(held), ["user_id", "question_id"], "left_semi")
    # users with the same memberships ask for a question once
    class_hits = (
        asked.select("class_id", "question_id").distinct()
        .join(classes.members.select("class_id", "org_id"), "class_id")
        .join(_org_grants(held), ["question_id", "org_id"], "left_semi")
        .select("class_id", "question_id")
    )
    by_org = asked.join(class_hits, ["class_id", "question_id"], "left_semi").select("user_id", "question_id")
    allowed = own.union(by_user).union(by_org).distinct().withColumn("can_overwrite", F.lit(True))
    return pairs.join(allowed, ["user_id", "question_id"], "left").withColumn(
        "can_overwrite", F.coalesce("can_overwrite", F.lit(False))
    )


def permission_listing(acl: DataFrame, users: DataFrame, orgs: DataFrame) -> DataFrame:
    """Every grant with the name of its grantee."""
    names = users.select(F.lit("user").alias("grantee_type"), F.col("user_id").alias("grantee_id"), "real_name")
    units = orgs.select(F.lit("org").alias("grantee_type"), F.col("org_id").alias("grantee_id"), "org_name")
    return (
        acl.join(names, ["grantee_type", "grantee_id"], "left")
        .join(units, ["grantee_type", "grantee_id"], "left")
        .withColumn("grantee_name", F.coalesce("real_name", "org_name", "grantee_id"))
        .drop("real_name", "org_name")
    )


def question_detail(question: DataFrame, users: DataFrame) -> DataFrame:
    """Questions with their creator's name."""
    names = users.select(F.col("user_id").alias("creator_id"), F.col("real_name").alias("creator_name"))
    return question.join(names, "creator_id", "left")


def pending_requests(acl: DataFrame, words: Words = Words()) -> DataFrame:
    """Grants waiting for review."""
    return acl.filter(F.col("review_status") == words.pending)
