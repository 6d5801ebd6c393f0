"""Queries over question text: cleaning, assembly, truncation, ids and text tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizgrove.functions import text, values
from quizgrove.operators import recommend
from quizgrove.plans.fixtures import table
from quizgrove.plans.registry import query


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _decoded_sql(expression: str) -> str:
    for entity, character in text.ENTITIES:
        expression = f"replace({expression}, {_quoted(entity)}, {_quoted(character)})"
    return expression


def clean_sql(expression: str, compat: bool = False) -> str:
    def strip(source: str, *patterns: str) -> str:
        for pattern in patterns:
            source = f"regexp_replace({source}, {_quoted(pattern)}, ' ', 'g')"
        return source

    once = _decoded_sql(f"coalesce({expression}, '')")
    twice = _decoded_sql(strip(once, *text.HIDDEN_BLOCKS, text.COMMENT, text.TAG))
    last = strip(twice, text.COMMENT, text.ANY_ANGLE if compat else text.TAG)
    return f"trim(regexp_replace({last}, {_quoted(text.SPACE)}, ' ', 'g'))"


@query("f1_clean_html", f"SELECT page_id, {clean_sql('html')} clean FROM pages")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html(F.col("html")).alias("clean"))


@query("f1_clean_html_compat", f"SELECT page_id, {clean_sql('html', compat=True)} clean FROM pages")
def clean_html_compat(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html(F.col("html"), compat=True).alias("clean"))


@query("f1_clean_html_all_entities")
def clean_html_all_entities(spark, sf_dir):
    cleaned = text.clean_html(F.col("html"), full_entities=True)
    return table(spark, sf_dir, "pages").select("page_id", cleaned.alias("clean"))


_PARTS = {"content": "text", "options": "concat('A. ', source)", "answer": "lang", "analysis": "concat('n=', n_chars)"}


def _document_parts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("content"),
        F.concat(F.lit("A. "), "source").alias("options"),
        F.col("lang").alias("answer"),
        F.concat(F.lit("n="), "n_chars").alias("analysis"),
        (F.col("doc_id") % 4 + 1).alias("type_id"),
    )


@query(
    "f2_build_text",
    f"""SELECT doc_id, substring(concat_ws(' ', nullif({clean_sql("text")}, ''),
 CASE WHEN doc_id%4+1 IN (1,2) THEN nullif({clean_sql(_PARTS["options"])}, '') END,
 nullif({clean_sql("lang")}, ''), nullif({clean_sql(_PARTS["analysis"])}, '')), 1, 2000) question_text,
 substring({clean_sql("text")}, 1, 2000) stem FROM documents""",
)
def build_text(spark, sf_dir):
    parts = _document_parts(spark, sf_dir)
    columns = [F.col(name) for name in ("content", "options", "answer", "analysis", "type_id")]
    return parts.select(
        "doc_id",
        text.build_text(*columns, only_stem=False).alias("question_text"),
        text.build_text(*columns).alias("stem"),
    )


@query(
    "f3_build_text_choice",
    f"""SELECT doc_id, concat_ws(' ', nullif({clean_sql("text")}, ''),
 CASE WHEN doc_id IN (1,2) OR starts_with(CAST(doc_id AS VARCHAR), '10') THEN nullif({clean_sql(_PARTS["options"])}, '') END)
 question_text FROM documents""",
)
def build_text_choice(spark, sf_dir):
    parts = _document_parts(spark, sf_dir)
    built = text.build_stem_with_options(F.col("content"), F.col("options"), F.col("doc_id"))
    return parts.select("doc_id", built.alias("question_text"))


_TOKENS = f"""list_filter(string_split(trim(regexp_replace(text, {_quoted(text.SPACE)}, ' ', 'g')), ' '), lambda x: x<>'')"""


@query(
    "f4_truncate",
    f"""SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) n_tokens,
 CASE WHEN len({_TOKENS})>8000 THEN array_to_string({_TOKENS}[1:7500], ' ') || ' [TRUNCATED]' ELSE text END kept
FROM documents""",
)
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.token_count(F.col("text")).cast("bigint").alias("n_tokens"),
        text.truncate_tokens(F.col("text")).alias("kept"),
    )


def _id_sql(expression: str) -> str:
    return f"""CASE WHEN regexp_matches({expression}, '^[0-9]{{1,18}}$') THEN CAST({expression} AS BIGINT)
 ELSE greatest(CAST(CAST('0x'||substr(sha1({expression}),1,16) AS UBIGINT) & 9223372036854775807 AS BIGINT), 1) END"""


@query(
    "f5_int64_id",
    f"""SELECT doc_id, {_id_sql("concat(source, doc_id)")} hashed_id,
 CASE WHEN regexp_matches(CAST(doc_id AS VARCHAR), '^[0-9]{{1,18}}$') THEN doc_id END number_id FROM documents""",
)
def int64_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.stable_id(F.concat("source", "doc_id")).alias("hashed_id"),
        text.stable_id(F.col("doc_id")).alias("number_id"),
    )


@query(
    "f13_preview",
    """SELECT doc_id, substring(text,1,120) preview,
 CASE WHEN length(text)>100 THEN substring(text,1,100)||'...' ELSE text END shortened FROM documents""",
)
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.preview(F.col("text")).alias("preview"),
        text.preview(F.col("text"), 100, "...").alias("shortened"),
    )


@query(
    "f14_percent",
    "SELECT l_orderkey, l_linenumber, round(l_discount*100,1) discount_percent FROM lineitem",
)
def percent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text.percent(F.col("l_discount")).alias("discount_percent")
    )


@query("f17_second_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') moment FROM events")
def second_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.second_text(F.col("ts")).alias("moment"))


@query(
    "f19_repeatable_id",
    "SELECT l_orderkey, concat('Q', substr(md5(concat_ws('|', l_orderkey, l_suppkey)),1,16)) new_id FROM lineitem",
)
def repeatable_id(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", values.repeatable_id("Q", F.col("l_orderkey"), F.col("l_suppkey")).alias("new_id")
    )


@query(
    "f20_looks_like_options",
    f"""SELECT doc_id, regexp_matches(text, {_quoted(text.OPTION_PATTERN)}) OR contains(text, '①') has_options
FROM documents""",
)
def looks_like_options(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.looks_like_options(F.col("text")).alias("has_options")
    )


@query(
    "p11_contains",
    """SELECT page_id, coalesce(contains(url, '.org'), false) has_marker,
 NOT coalesce(contains(url, '.org'), false) no_marker FROM pages""",
)
def contains(spark, sf_dir):
    marked = text.contains_marker(F.col("url"), ".org")
    return table(spark, sf_dir, "pages").select("page_id", marked.alias("has_marker"), (~marked).alias("no_marker"))


_PICK = """WITH tail AS (SELECT doc_id, lower(text) body FROM documents ORDER BY doc_id DESC LIMIT 10),
hits AS (SELECT doc_id, {hit} hit FROM tail)
SELECT doc_id FROM hits ORDER BY hit DESC, CASE WHEN hit THEN doc_id ELSE -doc_id END LIMIT 1"""


@query("p12_keyword_pick", _PICK.format(hit="(contains(body,'license') OR contains(body,'the '))"))
def keyword_pick(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return recommend.keyword_pick(documents, ["license", "the "], "doc_id").select("doc_id")


@query("p9_non_empty_text", f"SELECT page_id FROM pages WHERE length({clean_sql('html')})>0")
def non_empty_text(spark, sf_dir):
    cleaned = text.clean_html(F.col("html"))
    return table(spark, sf_dir, "pages").filter(F.length(cleaned) > 0).select("page_id")
