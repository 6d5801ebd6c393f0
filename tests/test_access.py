from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quizgrove.functions import paths
from quizgrove.operators import access, editing, organisation

WORDS = access.Words(approved="approved", pending="pending", rejected="rejected", super_admin="sysadmin")
USER = "user_id string, user_type string"
ORG = "user_id string, org_id string, org_path string, expires_at date"
QUESTION = "question_id long, subject string, creator_id string, org_path string, enabled int, created_at date"
ACL = "resource_id long, grantee_type string, grantee_id string, perm_level int, review_status string"


def covers(upper, lower, mode):
    if upper is None or lower is None:
        return False
    if mode == "compat":
        return lower.replace("/", "").startswith(upper.replace("/", ""))
    upper, lower = upper.strip("/"), lower.strip("/")
    return upper == "" or upper == lower or lower.startswith(upper + "/")


def literal_rows(questions, members, grants, mode):
    """The disjunctive join, row by row: (user, question, can_edit)."""
    rows = set()
    for qid, _, creator, q_path, enabled, _ in questions:
        if not enabled:
            continue
        held = [g for g in grants if g[0] == qid and g[4] == "approved" and g[3] >= 0] or [None]
        for user, org, m_path, expires in members:
            if expires is not None:
                continue
            for g in held:
                applies = g is not None and (
                    (g[1] == "user" and g[2] == user) or (g[1] == "org" and g[2] == org)
                )
                if covers(m_path, q_path, mode) or covers(q_path, m_path, mode) or applies:
                    rows.add((user, qid, int(creator == user or (applies and g[3] >= 1))))
    return rows


def random_bank(seed):
    rng = random.Random(seed)
    nodes = ["", "1", "2", "1/1", "1/16", "1/16/3", "2/5", "/2/6/", "11", None]
    orgs = [f"O{i}" for i in range(6)]
    users = [f"U{i}" for i in range(12)]
    import datetime as dt

    day = dt.date(2024, 1, 1)
    members = [
        (rng.choice(users[:10]), rng.choice(orgs), rng.choice(nodes), day.replace(year=1999) if rng.random() < 0.2 else None)
        for _ in range(25)
    ]
    questions = [
        (i, rng.choice(["a", "b"]), rng.choice(users), rng.choice(nodes), int(rng.random() < 0.8),
         day + dt.timedelta(days=rng.randrange(5)))
        for i in range(40)
    ]
    grants = [
        (rng.randrange(40), kind, rng.choice(users if kind == "user" else orgs), rng.randrange(3),
         rng.choice(["approved", "approved", "pending"]))
        for kind in rng.choices(["user", "org"], k=60)
    ]
    return users, members, questions, grants


def frames(spark, bank):
    users, members, questions, grants = bank
    return (
        spark.createDataFrame([(u, "teacher") for u in users], USER),
        spark.createDataFrame(questions, QUESTION),
        spark.createDataFrame(members, ORG),
        spark.createDataFrame(grants, ACL),
    )


@pytest.mark.parametrize("mode", ["segment", "compat"])
@pytest.mark.parametrize("seed", [1, 2])
def test_listing_and_counts_match_the_literal_join(spark, seed, mode):
    bank = random_bank(seed)
    users, members, questions, grants = bank
    expected = literal_rows(questions, members, grants, mode)
    rules = access.AccessRules(path_mode=mode, as_of="2024-01-01", words=WORDS)
    tables = frames(spark, bank)

    stats = access.overview_stats(*tables, {"a_questions": "a"}, rules).collect()
    subject = {q[0]: q[1] for q in questions}
    for row in stats:
        seen = {q for u, q, _ in expected if u == row.user_id}
        assert row.total_questions == len(seen)
        assert row.a_questions == sum(subject[q] == "a" for q in seen)

    created = {q[0]: q[5] for q in questions}
    for raw in (True, False):
        rows = expected
        if not raw:
            rows = {(u, q, max(e for a, b, e in expected if (a, b) == (u, q))) for u, q, _ in expected}
        page_one = access.visible_page(*tables, rules, limit=7, raw=raw).collect()
        page_two = access.visible_page(*tables, rules, page=2, limit=7, raw=raw).collect()
        for user in users:
            mine = sorted((r for r in rows if r[0] == user), key=lambda r: (-created[r[1]].toordinal(), r[1], -r[2]))
            for got, want in ((page_one, mine[:7]), (page_two, mine[7:14])):
                listed = sorted((r.place, r.question_id, r.can_edit) for r in got if r.user_id == user)
                assert [(q, e) for _, q, e in listed] == [(q, e) for _, q, e in want]


@pytest.mark.parametrize("mode", ["segment", "compat"])
def test_checks_match_the_literal_join(spark, mode):
    bank = random_bank(3)
    users, members, questions, grants = bank
    tables = frames(spark, bank)
    rules = access.AccessRules(path_mode=mode, as_of="2024-01-01", words=WORDS, enabled_only=False)
    everything = [(*q[:4], 1, q[5]) for q in questions]
    expected = {(u, q) for u, q, _ in literal_rows(everything, members, grants, mode)}
    pairs = spark.createDataFrame([(u, q[0]) for u in users for q in questions], "user_id string, question_id long")
    got = access.visibility_check(pairs, *tables, rules).filter("visible").collect()
    assert {(r.user_id, r.question_id) for r in got} == expected


def test_counts_with_many_shared_grants(spark):
    """Questions granted to several organisations of one user count once; their bits fill several words."""
    rng = random.Random(9)
    users, _, first, _ = random_bank(5)
    questions = [(q[0] + 40 * i, *q[1:]) for i in range(8) for q in first]
    members = [(u, f"O{o}", rng.choice(["1/1", "2", None]), None) for u in users[:8] for o in rng.sample(range(40), rng.choice([1, 4, 35]))]
    grants = [(q[0], "org", f"O{o}", 1, "approved") for q in questions for o in rng.sample(range(40), rng.choice([0, 1, 2, 30]))]
    grants += [(q[0], "user", rng.choice(users), 1, "approved") for q in questions[:40]]
    bank = (users, members, questions, grants)
    rules = access.AccessRules(as_of="2024-01-01", words=WORDS)
    expected = literal_rows(questions, members, grants, "segment")
    subject = {q[0]: q[1] for q in questions}
    for row in access.overview_stats(*frames(spark, bank), {"a_questions": "a", "b_questions": "b"}, rules).collect():
        seen = {q for u, q, _ in expected if u == row.user_id}
        wanted = (len(seen), *(sum(subject[q] == name for q in seen) for name in "ab"))
        assert (row.total_questions, row.a_questions, row.b_questions) == wanted


def test_shared_grants_are_words_of_bits(spark):
    """500 questions granted to 60 organisations make a row per organisation and word, not one per grant or pair."""
    q = spark.range(500).select(F.col("id").alias("question_id"), F.lit("1/1").alias("q_key"), F.lit(None).cast("string").alias("subject"))
    orgs = spark.range(60).select(F.col("id").cast("string").alias("org_id"))
    grants = q.select("question_id").join(orgs, F.lit(True)).unionByName(spark.createDataFrame([(1000, "0")], "question_id long, org_id string"))
    words = access._grant_words(grants, q.repartition(1))
    assert words.agg(F.sum(F.bit_count("bits"))).first()[0] == 500 * 60
    assert words.count() <= 60 * (500 // 64 + 1 + int(spark.conf.get("spark.sql.shuffle.partitions")))
    members = orgs.select(F.lit("c").alias("class_id"), "org_id")
    again = access._repeated_grants(grants, q, members, {}).collect()
    assert [(row.class_id, row.q_key, row.total_questions) for row in again] == [("c", "1/1", 500 * 59)]


def test_prefixes_of_empty_and_null_paths(spark):
    row = spark.range(1).select(
        paths.prefixes(F.lit("")).alias("empty"),
        paths.prefixes(F.lit("1/16")).alias("two"),
        paths.prefixes(F.lit("116"), "compat").alias("letters"),
        paths.prefixes(F.lit(None).cast("string")).alias("nothing"),
    ).first()
    assert row.empty == [""]
    assert row.two == ["", "1", "1/16"]
    assert row.letters == ["", "1", "11", "116"]
    assert row.nothing is None
    with pytest.raises(ValueError):
        paths.path_key(F.lit("x"), "other")


def test_super_admin_sees_everything_and_pages(spark):
    users, question, user_org, acl = frames(spark, random_bank(4))
    users = users.withColumn("user_type", F.lit("sysadmin"))
    rules = access.AccessRules(as_of="2024-01-01", words=WORDS)
    enabled = question.filter("enabled = 1").count()
    totals = access.overview_stats(users, question, user_org, acl, {}, rules).select("total_questions").distinct().collect()
    assert [r.total_questions for r in totals] == [enabled]
    assert access.visible_page(users, question, user_org, acl, rules).isEmpty()
    first, second = access.admin_page(question, 1, 10), access.admin_page(question, 2, 10)
    assert first.count() == 10 and first.join(second, "question_id").isEmpty()
    filtered = access.admin_page(question, criteria={"subject": "a", "grade": "", "nothing": 3})
    assert {r.subject for r in filtered.collect()} == {"a"}


def test_pending_grant_counts_only_in_compat(spark):
    question = spark.createDataFrame([(1, "a", "U9", "1", 1, None)], QUESTION)
    user_org = spark.createDataFrame([], ORG)
    acl = spark.createDataFrame([(1, "user", "U1", 1, "pending")], ACL)
    pairs = spark.createDataFrame([("U1", 1)], "user_id string, question_id long")
    rules = access.AccessRules(words=WORDS)
    assert not access.edit_check(pairs, question, user_org, acl, rules).first().can_overwrite
    assert access.edit_check(pairs, question, user_org, acl, rules, require_approved=False).first().can_overwrite


def test_home_paths_and_missing_nodes(spark):
    users = spark.createDataFrame([("A",), ("B",), ("C",)], "user_id string")
    orgs = spark.createDataFrame([("o1", "x", "1000"), ("o2", "y", "1000/1100"), ("o3", "z", "2000/1/2")],
                                 "org_id string, org_name string, org_path string")
    user_org = spark.createDataFrame([("A", "o2"), ("B", "o3")], "user_id string, org_id string")
    homes = organisation.home_paths(users, user_org, orgs)
    got = {r.user_id: (r.tenant, r.default_path) for r in homes.collect()}
    assert got == {"A": ("1000", "1000/1100"), "B": ("2000", "2000"), "C": ("TC", "TC")}
    org_rows, member_rows = organisation.missing_nodes(homes, user_org, orgs)
    assert {r.org_id for r in org_rows.collect()} == {"PRV_A", "PRV_B", "PRV_C", "TC"}
    assert ("C", "TC") in {(r.user_id, r.org_id) for r in member_rows.collect()}


def test_lineage_of_long_chains_and_cycles(spark):
    chain = spark.range(200).select(
        F.col("id").alias("question_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id")
    )
    rows = editing.fork_lineage(chain).collect()
    assert all(r.origin_id == 0 and r.depth == r.question_id for r in rows) and len(rows) == 200
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "question_id long, parent_id long")
    with pytest.raises(ValueError):
        editing.fork_lineage(cycle)


def test_lists_of_many_users_are_made_by_many_tasks(spark, monkeypatch):
    """Users of one class and a question table with odd rows: one array a user, rows in tasks of bounded size."""
    import datetime as dt

    monkeypatch.setattr(access, "LISTED_ROWS", 100)
    day = dt.date(2024, 1, 1)
    users = spark.createDataFrame([(f"U{i}", "one") for i in range(90)] + [("V", "none")], "user_id string, class_id string")
    shown = [("one", None, day), ("one", 3, day), ("one", 4, None), ("one", 9, day + dt.timedelta(days=1))]
    own = [("U1", 2, day), ("U1", 3, day), ("U1", 3, day), ("U2", 7, None), ("V", 5, day)]
    found = access._listed(
        users, spark.createDataFrame(shown, "class_id string, question_id long, created_at date"),
        spark.createDataFrame(own, "user_id string, question_id long, created_at date"), 4,
    )
    lists = {}
    for row in found.collect():
        lists.setdefault(row["user_id"], []).append(row["question_id"])
    assert {user: sorted(x or 0 for x in ids) for user, ids in lists.items() if user in ("U0", "U1", "U2", "V")} == {
        "U0": [0, 3, 4, 9], "U1": [0, 2, 3, 9], "U2": [0, 3, 4, 9], "V": [5],
    }
    assert len(lists) == 91 and found.rdd.getNumPartitions() == 4


def test_checked_pairs_are_read_once(spark):
    # U0 through a path, U1 as administrator, U2 through the organisation's grant, the rest unknown
    pairs = spark.range(40).select(F.concat(F.lit("U"), F.col("id") % 4).alias("user_id"), F.expr("nullif(id div 8, 4)").alias("question_id"))
    users = spark.createDataFrame([("U1", "sysadmin"), ("U1", "sysadmin"), ("U2", "x")], USER)
    members = spark.createDataFrame([("U0", "A", "1", None), ("U2", "B", "3", None), ("U2", "C", None, None)], ORG)
    questions = [(0, "a", "U9", "1/1", 1, None), (1, "a", "U9", "2", 1, None), (1, "a", "U9", "1", 0, None), (2, "a", "U9", "1", 0, None)]
    question = spark.createDataFrame(questions, QUESTION)
    acl = spark.createDataFrame([(1, "org", "B", 0, "approved"), (1, "org", "C", 0, "approved"), (0, "user", "U2", 0, "pending")], ACL)
    for enabled_only, by_path in ((True, {0}), (False, {0, 1, 2})):
        rules = access.AccessRules(enabled_only=enabled_only, check_expiry=False, words=WORDS)
        checked = access.visibility_check(pairs, users, question, members, acl, rules)
        assert "Range (" not in checked._jdf.queryExecution().optimizedPlan().toString()
        rows = checked.collect()
        assert len(rows) == 20 and checked.columns == ["user_id", "question_id", "visible"]
        seen = {(r.user_id, r.question_id) for r in rows if r.visible}
        assert seen == {("U0", q) for q in by_path} | {("U1", q) for q in (0, 1, 2)} | {("U2", 1)}
