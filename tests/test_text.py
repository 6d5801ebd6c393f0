from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quizgrove.functions import text, values
from quizgrove.operators import recommend


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a<!-- note -->b", "a b"),
        ("&lt;b&gt;bold&lt;/b&gt;", "bold"),
        ("x&amp;nbsp;y", "x y"),
        ("<script>var a='<p>';</script>text<style>p{}</style>", "text"),
        ("x<3 and y>2", "x<3 and y>2"),
        ("  a 　b\n\tc ", "a b c"),
        ("<p>one<br>two</p>", "one two"),
        (None, ""),
    ],
)
def test_clean_html(spark, raw, clean):
    assert one(spark, raw, text.clean_html) == clean


def test_clean_html_compat_eats_inequalities(spark):
    assert one(spark, "x<3 and y>2", lambda c: text.clean_html(c, compat=True)) == "x 2"


def test_full_entities_agree_with_the_short_list_and_go_beyond(spark):
    both = "<p>&eacute;t&#233; &amp; &hearts; &lt;i&gt;x&lt;/i&gt;</p>"
    assert one(spark, both, lambda c: text.clean_html(c, full_entities=True)) == "été & ♥ x"
    plain = "a &amp; b &copy; <b>c</b>"
    assert one(spark, plain, lambda c: text.clean_html(c, full_entities=True)) == one(spark, plain, text.clean_html)


@pytest.mark.parametrize("value", ["0", "007", "1" * 18, "1" * 19, "中文题目", "", "q-1", "１２"])
def test_stable_id(spark, value):
    if value.isascii() and value.isdigit() and len(value) <= 18:
        expected = int(value)
    else:
        expected = int.from_bytes(hashlib.sha1(value.encode()).digest()[:8], "big") & (2**63 - 1) or 1
    assert one(spark, value, text.stable_id) == expected


def test_build_text_rules(spark):
    rows = spark.createDataFrame(
        [("stem", "A. x", "ans", "why", 1), ("stem", "A. x", None, "", 3), (None, "", "", None, None)],
        "content string, options string, answer string, analysis string, type_id int",
    )
    columns = [F.col(name) for name in ("content", "options", "answer", "analysis", "type_id")]
    full = [r.t for r in rows.select(text.build_text(*columns, only_stem=False).alias("t")).collect()]
    assert full == ["stem A. x ans why", "stem", ""]
    cut = rows.select(text.build_text(*columns, limit=2).alias("t")).first().t
    assert cut == "st"


@pytest.mark.parametrize(("type_id", "has_options"), [("1", True), ("2", True), ("10", True), ("1003", True), ("3", False), (None, False)])
def test_choice_types(spark, type_id, has_options):
    row = spark.createDataFrame([("s", "o", type_id)], "c string, o string, t string")
    got = row.select(text.build_stem_with_options(F.col("c"), F.col("o"), F.col("t").cast("int")).alias("r")).first().r
    assert got == ("s o" if has_options else "s")


def test_truncation_keeps_short_texts_whole(spark):
    assert one(spark, "a  b c", lambda c: text.truncate_tokens(c, 3, 2)) == "a  b c"
    assert one(spark, "a  b c d", lambda c: text.truncate_tokens(c, 3, 2)) == "a b [TRUNCATED]"
    assert one(spark, "  ", text.token_count) == 0


def test_small_expressions(spark):
    assert one(spark, "abcdef", lambda c: text.preview(c, 3, "...")) == "abc..."
    assert one(spark, "abc", lambda c: text.preview(c, 3, "...")) == "abc"
    assert one(spark, None, lambda c: text.contains_marker(c, "x")) is False
    assert one(spark, "① one", text.looks_like_options) and one(spark, "B、two", text.looks_like_options)
    assert one(spark, '{"__op":"u"}', lambda c: values.json_field(c, "op")) == "u"
    assert one(spark, '{"op":"c"}', lambda c: values.json_field(c, "op")) == "c"
    assert one(spark, "7", lambda c: values.label(c.cast("int"), values.TYPE_NAMES, values.OTHER_TYPE)) == "未知"
    assert one(spark, None, lambda c: values.days_behind(c.cast("date"), F.current_date())) == 0


def test_sample_row_is_repeatable_and_prefers_long_contents(spark):
    rows = spark.createDataFrame([(1, ""), (2, "ab"), (3, "long enough"), (4, "also long")], "question_id long, content string")
    picks = {recommend.sample_row(rows, F.col("content"), seed).first().question_id for seed in range(12)}
    assert picks == {3, 4}
    again = [recommend.sample_row(rows.repartition(3), F.col("content"), 5).first().question_id for _ in range(2)]
    assert again[0] == again[1] == recommend.sample_row(rows, F.col("content"), 5).first().question_id
    short = rows.filter("question_id < 3")
    assert recommend.sample_row(short, F.col("content"), 1).first().question_id == 2


def test_keyword_pick(spark):
    rows = spark.createDataFrame([(i, "Angle" if i in (3, 15, 17) else None) for i in range(20)], "seq long, content string")
    assert recommend.keyword_pick(rows, ["angle"], "seq").first().seq == 15
    assert recommend.keyword_pick(rows, ["circle"], "seq").first().seq == 19


def test_squeeze_knows_all_white_space_and_nothing_else(spark):
    points = [*range(0x2100), *range(0x2FF0, 0x3010), 0xFEFF, 0x1F600]
    rows = spark.createDataFrame([(point, f"a{chr(point)}b") for point in points if point], "point int, v string")
    spaces = {row.point for row in rows.filter(text.squeeze(F.col("v")) == "a b").collect()}
    assert spaces == {point for point in points if point and chr(point).isspace()}
    assert "&&" in text.SPACE_IN_JAVA and "&&" not in text.SPACE
