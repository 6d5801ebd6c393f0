"""The physical plans: no pair joins, filters and columns at the scan, shared folder in use."""

from __future__ import annotations

import pytest

from quizgrove import session
from quizgrove.plans.catalogue import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["x13_overview_stats", "x4_visible_list", "x6_visibility_check", "x7_edit_permission", "p7_org_subtree",
     "r9_recall", "l23_co_occurrence", "l24_rater_agreement", "c2_incremental", "j11_anti_null_safe"],
)
def test_no_pair_joins(spark, name):
    text = plan(spark, name)
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = QUERIES["p14_since"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "l_comment" not in text and "l_extendedprice" not in text


def test_newest_first_page_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "t3_newest")


def test_pages_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "x4_visible_list")


class NamedFolder:
    """Just the part of a session that names the shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return "/shared/by-all/" if name == session.CHECKPOINT_SETTING else default


def test_shared_folder_is_the_named_one():
    assert session.shared_folder(NamedFolder) == "/shared/by-all"
    assert session.new_folder(NamedFolder, "x") != session.new_folder(NamedFolder, "x")
    assert session.new_folder(NamedFolder, "x").startswith("/shared/by-all/x-")


def test_bucketed_copies_are_joined_without_a_shuffle(spark):
    from quizgrove.operators import replicate
    from quizgrove.plans.replicate import _bucketed_pair

    names = _bucketed_pair(spark, SF_DIR)
    source, target = (spark.table(name).hint("merge") for name in names)
    joined = replicate._paired(source, target, ["o_orderkey"])
    missing = replicate.one_per_key(replicate.missing_rows(source, target, ["o_orderkey"]), ["o_orderkey"])
    for rows in (joined, missing):
        text = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
    verified = replicate.verify(spark.table(names[0]), spark.table(names[1]), ["o_orderkey"], colocated=True)
    text = verified._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == text.count("Exchange SinglePartition")  # the counts alone
