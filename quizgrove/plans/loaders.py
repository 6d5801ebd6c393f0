"""Queries that write question files with Spark and load them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizgrove.functions import text
from quizgrove.operators import recommend as recommend_operators
from quizgrove.plans.fixtures import table, with_views
from quizgrove.plans.recommend import _growth, _GROWTH
from quizgrove.plans.registry import query
from quizgrove.plans.text import clean_sql
from quizgrove.session import new_folder
from quizgrove.sources import files


def _export(spark, sf_dir, separator, width, odd_lines=True):
    """Documents as header-less lines; text cleaned so that a line is a row.

    ``odd_lines``: beside every tenth document a short line, and a line with a cell too many.
    """
    rows = table(spark, sf_dir, "documents")
    cells = [F.lit("x")] * width
    cells[0] = F.col("doc_id").cast("string")
    cells[1] = F.concat(F.lit("t"), F.col("doc_id") % 4 + 1)
    cells[10] = F.replace(text.clean_html(F.col("text")), F.lit(separator), F.lit(" "))
    cells[11] = F.concat(F.lit("A. "), "lang", F.lit(" B. "), "source")
    path = new_folder(spark, "export") + ".csv"
    line = F.concat_ws(separator, *cells)
    odd = F.lit(odd_lines)
    short = F.when(odd & (F.col("doc_id") % 10 == 0), F.concat(F.lit("s"), "doc_id", F.lit(separator), F.lit("t0")))
    long = F.when(odd & (F.col("doc_id") % 10 == 1), F.concat_ws(separator, line, F.lit("more")))
    rows.select(F.explode(F.array_compact(F.array(line, short, long))).alias("value")).write.text(path)
    return path


_CLEAN = clean_sql("text")


@query(
    "s2_detect_sep",
    """WITH line AS (SELECT o_orderkey, concat(o_orderkey, '|', o_custkey, '|', o_orderstatus) line FROM orders),
head AS (SELECT left(string_agg(line, chr(10) ORDER BY o_orderkey), 2048) h FROM (SELECT * FROM line ORDER BY o_orderkey LIMIT 2048)),
n AS (SELECT CAST(length(h)-length(replace(h,'|','')) AS BIGINT) n FROM head)
SELECT 'comma' name, CAST(0 AS BIGINT) tabs, n commas, ',' separator FROM n UNION ALL SELECT 'tab', n, 0, chr(9) FROM n""",
)
def detect_sep(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    head = rows.orderBy("o_orderkey").limit(files.SNIFF_CHARACTERS).coalesce(1)
    found = []
    for name, separator in (("comma", ","), ("tab", "\t")):
        path = new_folder(spark, "sniffed")
        head.write.options(sep=separator).csv(path)
        found.append(files.separator_counts(spark, path).select(F.lit(name).alias("name"), "*"))
    return found[0].unionByName(found[1])


@query(
    "s3_rejected",
    f"""SELECT concat_ws('|', doc_id, concat('t', doc_id%4+1), 'x','x','x','x','x','x','x','x', replace({_CLEAN},'|',' '),
 concat('A. ', lang, ' B. ', source), 'x','x','x','more') line, 16 n_cells FROM documents WHERE doc_id%10=1""",
)
def rejected(spark, sf_dir):
    return files.rejected_lines(spark, _export(spark, sf_dir, "|", 15), "|")


@query("s5_options", "SELECT doc_id, concat('A. ', lang, ' B. ', source) options, lang FROM documents")
def options(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("A. "), "lang", F.lit(" B. "), "source").alias("column_5"), "lang"
    )
    return files.name_options(rows)


@query(
    "r5_update_from_file",
    f"""SELECT doc_id question_id, nullif(replace({_CLEAN},',',' '),'') content, concat('A. ', lang, ' B. ', source) options
FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND length({_CLEAN})>0""",
)
def update_from_file(spark, sf_dir):
    rows = files.load_legacy(spark, _export(spark, sf_dir, ",", 15, odd_lines=False))
    batch = rows.select(
        F.col("question_id").cast("bigint").alias("question_id"), "content", "options", F.lit(0).alias("seq")
    )
    added = recommend_operators.add_questions(table(spark, sf_dir, "f_item"), batch)
    return added.filter(F.size("embedding") == 64).select("question_id", "content", "options")


@query(
    "s3_load",
    f"""SELECT CAST(doc_id AS VARCHAR) question_id, concat('t', doc_id%4+1) type_id, nullif({_CLEAN},'') content,
 concat('A. ', lang, ' B. ', source) options, 'x' question_archive FROM documents
UNION ALL SELECT concat('s', doc_id), 't0', NULL, NULL, NULL FROM documents WHERE doc_id%10=0""",
)
def load(spark, sf_dir):
    rows = files.load_export(spark, _export(spark, sf_dir, "\t", 27), "\t")
    return rows.select("question_id", "type_id", "content", "options", "question_archive")


@query(
    "s4_legacy",
    f"""SELECT CAST(doc_id AS VARCHAR) question_id, concat('t', doc_id%4+1) subject_id, nullif(replace({_CLEAN},',',' '),'') content,
 concat('A. ', lang, ' B. ', source) options, 'x' analysis FROM documents
UNION ALL SELECT concat('s', doc_id), 't0', NULL, NULL, NULL FROM documents WHERE doc_id%10=0""",
)
def legacy(spark, sf_dir):
    rows = files.load_legacy(spark, _export(spark, sf_dir, ",", 15))
    return rows.select("question_id", "subject_id", "content", "options", "analysis")


@query(
    "s16_tsv_roundtrip",
    f"""SELECT CAST(doc_id AS VARCHAR) question_id, nullif({_CLEAN},'') content, CAST(n_chars AS VARCHAR) n_chars, '' answer FROM documents""",
)
def tsv_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("question_id"), text.clean_html(F.col("text")).alias("content"), "n_chars"
    )
    saved = files.save_enriched(rows, new_folder(spark, "enriched") + ".csv")
    return files.load_export(spark, saved, "\t").select("question_id", "content", "n_chars", "answer")


@query(
    "s17_model_roundtrip",
    f"""{with_views("f_item")} SELECT question_id, type_id, round(list_sum(CAST(embedding AS DOUBLE[])),6) total,
 CAST(len(embedding) AS INT) dimension FROM f_item""",
)
def model_roundtrip(spark, sf_dir):
    path = new_folder(spark, "model")
    files.save_model(table(spark, sf_dir, "f_item"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return files.load_model(spark, path).select(
        "question_id", "type_id", F.round(total, 6).alias("total"), F.size("embedding").alias("dimension")
    )


@query(
    "s18_report",
    f"""{with_views("f_external")}, {_GROWTH}
SELECT iteration, CAST(total-added AS BIGINT) before, added, CAST(total AS BIGINT) after FROM grown""",
)
def report(spark, sf_dir):
    path = new_folder(spark, "report")
    files.save_report(_growth(spark, sf_dir), path)
    return spark.read.schema("iteration bigint, before bigint, added bigint, after bigint").json(path)


_BOX = ["l_linenumber", "l_suppkey", "l_linenumber + CAST(l_quantity AS INT)", "l_suppkey + 10"]


@query(
    "s19_nested_json",
    """SELECT CAST(l_orderkey AS INT) qid, count(*) n_fragments, CAST(min(l_linenumber) AS INT) x1, CAST(min(l_suppkey) AS INT) y1,
 CAST(max(l_linenumber+CAST(l_quantity AS INT)) AS INT) x2, CAST(max(l_suppkey+10) AS INT) y2,
 CAST(sum(CAST(l_quantity AS INT)*10) AS BIGINT) area FROM lineitem GROUP BY l_orderkey""",
)
def nested_json(spark, sf_dir):
    path = new_folder(spark, "fragments")
    box = F.array(*[F.expr(f"CAST({corner} AS INT)") for corner in _BOX])
    question = F.struct(F.col("l_orderkey").cast("int").alias("qid"), box.alias("bbox"))
    table(spark, sf_dir, "lineitem").select(F.array(question).alias("big_questions")).write.json(path)
    return files.envelopes(files.page_fragments(spark, path, multi_line=False))


@query("s20_first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark, sf_dir):
    return files.first_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
