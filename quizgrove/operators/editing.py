"""Batches of changes to the question bank: create, overwrite or fork, request, resolve, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizgrove.functions import paths
from quizgrove.operators.access import AccessRules, Words, edit_check
from quizgrove.session import new_folder, saved


def create_questions(
    requests: DataFrame, homes: DataFrame, orgs: DataFrame, words: Words = Words()
) -> tuple[DataFrame, DataFrame]:
    """Question rows and owner grants for a batch of create requests.

    ``requests``: request_id, user_id, title, content, type, subject, grade, difficulty, only_me,
    custom_path. The path is the private one, else the given one if it exists, else the default.
    """
    known = orgs.select(F.col("org_path").alias("custom_path")).distinct().withColumn("known", F.lit(True))
    rows = (
        requests.join(homes.select("user_id", "tenant", "default_path"), "user_id", "left")
        .join(known, "custom_path", "left")
        .withColumn("tenant", F.coalesce("tenant", paths.fallback_tenant(F.col("user_id"))))
        .withColumn("question_id", F.concat(F.lit("Q"), F.col("request_id")))
        .withColumn(
            "org_path",
            F.when(F.col("only_me"), paths.private_path(F.col("tenant"), F.col("user_id")))
            .when(F.col("known"), paths.trimmed(F.col("custom_path")))
            .otherwise(F.coalesce("default_path", "tenant")),
        )
    )
    questions = rows.select(
        "question_id", "title", "content", "type", "subject", "grade", "org_path",
        F.coalesce("difficulty", F.lit(words.default_difficulty)).alias("difficulty"),
        F.col("user_id").alias("creator_id"),
        F.lit(1).alias("enabled"),
    )
    grants = rows.select(
        F.concat_ws("_", F.lit("ACL"), "question_id", "user_id").alias("acl_id"),
        F.col("question_id").alias("resource_id"),
        F.lit(words.resource_type).alias("resource_type"),
        F.lit("user").alias("grantee_type"),
        F.col("user_id").alias("grantee_id"),
        F.lit(2).alias("perm_level"),
        F.lit(words.own_kind).alias("perm_kind"),
        F.lit(words.own_source).alias("perm_source"),
        F.lit(words.request_none).alias("request_status"),
        F.col("user_id").alias("creator_id"),
    )
    return questions, grants


def apply_edits(
    edits: DataFrame,
    question: DataFrame,
    user_org: DataFrame,
    acl: DataFrame,
    rules: AccessRules = AccessRules(),
    require_approved: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table after allowed overwrites, the fork rows made by other edits, and the refused edits.

    ``edits``: edit_id, user_id, question_id, new_content, overwrite. The last edit of a question wins. Edits without a
    user and those of no or an unknown question are refused: they come back with their columns and a ``reason``.
    """
    known = question.select("question_id").distinct()
    unknown = edits.join(known, "question_id", "left_anti").select(*edits.columns, F.lit("unknown question").alias("reason"))
    nameless = edits.filter(F.col("user_id").isNull()).join(known, "question_id", "left_semi")
    refused = unknown.unionByName(nameless.select(*edits.columns, F.lit("no user").alias("reason")))
    rights = edit_check(edits, question, user_org, acl, rules, require_approved)
    judged = edits.join(rights, ["user_id", "question_id"]).withColumn(
        "in_place", F.col("can_overwrite") & F.coalesce("overwrite", F.lit(False))
    )
    judged = saved(judged, "judged-edits")  # overwrites and forks both read it
    # by time if the edits have one, else by their number: a longer id is a later one
    number = [F.char_length("edit_id"), F.col("edit_id")]
    order = F.struct(*([F.col("edited_at")] if "edited_at" in edits.columns else []), *number)
    last = judged.filter("in_place").groupBy("question_id")
    last = last.agg(F.max_by(F.struct("new_content"), order).alias("last_edit"))
    updated = (
        question.join(last, "question_id", "left")
        .withColumn("content", F.when(F.col("last_edit").isNull(), F.col("content")).otherwise(F.col("last_edit.new_content")))
        .drop("last_edit")
    )
    copies = judged.filter(~F.col("in_place")).select(
        "edit_id", "question_id", "new_content", F.col("user_id").alias("new_creator")
    )
    forks = (
        question.drop("parent_id", "content", "created_at")
        .join(copies, "question_id")
        .withColumn("parent_id", F.col("question_id"))
        .withColumn("question_id", F.concat(F.lit("Q"), F.col("edit_id")))
        .withColumn("creator_id", F.col("new_creator"))
        .withColumn("enabled", F.lit(1))
        .withColumnRenamed("new_content", "content")
        .drop("edit_id", "new_creator")
    )
    return updated, forks, refused


def submit_requests(requests: DataFrame, acl: DataFrame, words: Words = Words()) -> DataFrame:
    """New edit requests, one per (user, question), unless a live one exists."""
    live = acl.filter(
        (F.col("perm_level") == 1)
        & (F.col("grantee_type") == "user")
        & F.col("review_status").isin(words.pending, words.approved)
    ).select(F.col("grantee_id").alias("user_id"), F.col("resource_id").alias("question_id"))
    fresh = requests.groupBy("user_id", "question_id").agg(F.min("requested_at").alias("requested_at"))
    return fresh.join(live, ["user_id", "question_id"], "left_anti").select(
        F.concat_ws("_", F.lit("REQ"), "question_id", "user_id").alias("acl_id"),
        F.col("question_id").alias("resource_id"),
        F.lit(words.resource_type).alias("resource_type"),
        F.lit("user").alias("grantee_type"),
        F.col("user_id").alias("grantee_id"),
        F.lit(1).alias("perm_level"),
        F.lit(words.edit_kind).alias("perm_kind"),
        F.lit(words.edit_source).alias("perm_source"),
        F.lit(words.request_open).alias("request_status"),
        F.lit(words.pending).alias("review_status"),
        F.col("user_id").alias("creator_id"),
        F.col("user_id").alias("requester_id"),
        "requested_at",
    )


def resolve_requests(
    decisions: DataFrame, acl: DataFrame, question: DataFrame, users: DataFrame, words: Words = Words()
) -> DataFrame:
    """The grant table after the decisions (X11).

    ``decisions``: acl_id, resource_id, approver_id, action, decided_at. Only ``approve`` and
    ``reject`` count, and only from the question's creator or a super administrator.
    """
    owners = question.select(F.col("question_id").alias("resource_id"), F.col("creator_id").alias("approver_id"))
    supers = users.filter(F.col("user_type") == words.super_admin).select(F.col("user_id").alias("approver_id"))
    valid = decisions.filter(F.col("action").isin("approve", "reject"))
    existing = valid.join(question.select(F.col("question_id").alias("resource_id")), "resource_id", "left_semi")
    allowed = (
        valid.join(owners, ["resource_id", "approver_id"], "left_semi")
        .unionByName(existing.join(supers, "approver_id", "left_semi"))
        .groupBy("acl_id", "resource_id")
        .agg(F.max_by(F.struct("action", "approver_id"), F.struct("decided_at", "approver_id")).alias("last"))
        .select(
            "acl_id",
            "resource_id",
            F.when(F.col("last.action") == "approve", words.approved).otherwise(words.rejected).alias("new_status"),
            F.col("last.approver_id").alias("new_approver"),
        )
    )
    merged = acl.join(allowed, ["acl_id", "resource_id"], "left")
    columns = set(acl.columns)
    null = F.lit(None).cast("string")
    old_request = F.col("request_status") if "request_status" in columns else null
    old_approver = F.col("approver_id") if "approver_id" in columns else null
    return (
        merged.withColumn("review_status", F.coalesce("new_status", "review_status"))
        .withColumn("request_status", F.coalesce(F.col("new_status"), old_request))
        .withColumn("approver_id", F.coalesce(F.col("new_approver"), old_approver))
        .drop("new_status", "new_approver")
    )


def fork_lineage(question: DataFrame) -> DataFrame:
    """Origin and number of forks between for every question.

    Each round doubles the distance covered, so a chain of n forks needs log2(n) rounds. A round writes the questions
    whose origin is not yet certain and, apart, those that are done: losing an executor costs one round, finished rows
    are not written again, and the plan does not grow. No chain is longer than there are questions, so a
    depth beyond their number is a cycle.
    """
    spark, count = question.sparkSession, question.count()
    folder = new_folder(spark, "lineage")
    state = question.select(
        "question_id",
        F.coalesce("parent_id", "question_id").alias("origin_id"),
        F.col("parent_id").isNotNull().cast("bigint").alias("depth"),
    )
    state.filter("depth = 0").write.parquet(f"{folder}/done/round=0")
    state.filter("depth > 0").write.parquet(f"{folder}/open/round=0")
    read = spark.read.schema(state.schema)
    number = 0
    while not (left := read.parquet(f"{folder}/open/round={number}")).isEmpty():
        if left.agg(F.max("depth")).first()[0] > count:
            raise ValueError("parent_id has a cycle")
        jump = left.select(F.col("question_id").alias("origin_id"), F.col("origin_id").alias("further"), F.col("depth").alias("more"))
        moved = left.join(jump, "origin_id", "left").select(
            "question_id",
            F.coalesce("further", "origin_id").alias("origin_id"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("more").isNotNull().alias("moved"),
        )
        # what did not move stands at a question without an open row: a finished one, whose own origin counts
        number += 1
        done = read.parquet(f"{folder}/done/round=0", *[f"{folder}/done/round={n}" for n in range(1, number)])
        ends = done.select(F.col("question_id").alias("origin_id"), F.col("origin_id").alias("end"), F.col("depth").alias("beyond"))
        closed = moved.filter("NOT moved").join(ends, "origin_id", "left")
        closed = closed.select("question_id", F.coalesce("end", "origin_id").alias("origin_id"), (F.col("depth") + F.coalesce("beyond", F.lit(0))).alias("depth"))
        closed.write.parquet(f"{folder}/done/round={number}")
        moved.filter("moved").drop("moved").write.parquet(f"{folder}/open/round={number}")
    return read.parquet(*[f"{folder}/done/round={n}" for n in range(number + 1)])
