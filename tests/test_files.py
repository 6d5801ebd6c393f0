from __future__ import annotations

import json

from pyspark.sql.types import ByteType, DateType, DecimalType, IntegerType, LongType, StringType

from quizgrove.session import finished_numbers
from quizgrove.sources import files, tables


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_separator(spark, tmp_path):
    assert files.detect_separator(spark, put(tmp_path, "a.csv", "a,b\tc,d\n")) == ","
    assert files.detect_separator(spark, put(tmp_path, "b.csv", "a,b\tc\n")) == "\t"
    assert files.detect_separator(spark, put(tmp_path, "c.csv", "plain\n")) == ","


def test_export_with_header(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'question_id,content\n001,"quoted"\n2\n3,x,too,many\n')
    rows = {r.question_id: r for r in files.load_export(spark, path).collect()}
    assert set(rows) == {"001", "2"}
    assert rows["001"].content == '"quoted"' and rows["001"].answer == "" and rows["2"].content is None


def test_export_without_header(spark, tmp_path):
    full = "\t".join(f"v{i}" for i in range(27))
    path = put(tmp_path, "q.tsv", f"{full}\n{full}\textra\nshort\tonly\n")
    rows = files.load_export(spark, path)
    assert tuple(rows.columns) == files.EXPORT_COLUMNS
    assert sorted(r.question_id for r in rows.collect()) == ["short", "v0"]


def test_narrow_export_without_header_gets_key_columns(spark, tmp_path):
    rows = files.load_export(spark, put(tmp_path, "n.csv", "1,2,3\n"))
    row = rows.first()
    assert (row.question_id, row.type_id, row.content, row.analysis) == ("1", "2", "", "")


def test_legacy_positions_and_options(spark, tmp_path):
    def line(name, option):
        cells = [f"{name}{i}" for i in range(15)]
        cells[11] = option
        return "\t".join(cells)

    path = put(tmp_path, "l.tsv", f"{line('a', 'A. x')}\n{line('b', '')}\n{line('c', '① y')}\n")
    row = files.load_legacy(spark, path).orderBy("question_id").first()
    assert (row.question_id, row.subject_id, row.options, row.analysis) == ("a0", "a1", "A. x", "a14")
    empty = put(tmp_path, "e.tsv", f"{line('a', '')}\n{line('b', 'B、z')}\n{line('c', '')}\n")
    assert files.load_legacy(spark, empty).orderBy("question_id").first().options is None
    assert "options" not in files.load_legacy(spark, empty, first_row=True).columns


def test_enriched_name_and_round_trip(spark, tmp_path):
    assert files.enriched_path("/x/set.csv") == files.enriched_path("/x/set_enriched.csv") == "/x/set_enriched.csv"
    rows = spark.createDataFrame([("1", "two\tlines\nhere", None)], "question_id string, content string, answer string")
    saved = files.save_enriched(rows, str(tmp_path / "set.csv"))
    back = files.load_export(spark, saved, "\t").first()
    assert (back.question_id, back.content) == ("1", "two lines here")


def test_page_fragments(spark, tmp_path):
    document = {"big_questions": [
        {"qid": 1, "bbox": [0, 0, 10, 10]}, {"qid": 1, "bbox": [5, 10, 20, 30]}, {"qid": 2, "bbox": [1, 1, 2, 3]},
    ]}
    path = put(tmp_path, "pages.json", json.dumps(document, indent=1))
    rows = {r.qid: r for r in files.envelopes(files.page_fragments(spark, path)).collect()}
    assert (rows[1].n_fragments, rows[1].x1, rows[1].y1, rows[1].x2, rows[1].y2, rows[1].area) == (2, 0, 0, 20, 30, 400)
    assert rows[2].area == 2


def test_type_map():
    kinds = {
        "tinyint(1)": ByteType(), "int(11)": IntegerType(), "int(10) unsigned": LongType(), "bigint": LongType(),
        "bigint(20) unsigned": DecimalType(20, 0), "decimal(5,4)": DecimalType(5, 4), "decimal(8)": DecimalType(8, 0),
        "varchar(50)": StringType(), "date": DateType(), "geometry": StringType(),
    }
    for kind, expected in kinds.items():
        assert tables.spark_type(kind) == expected
    schema = tables.spark_schema([("snapshot_date", "date", False), ("rate", "decimal(5,4)", True)])
    assert schema.simpleString() == "struct<snapshot_date:date,rate:decimal(5,4)>"
    assert tables.key_columns([("a", ""), ("b", "PRI"), ("c", "UNI")]) == ["b", "c"]
    assert tables.key_columns([("a", ""), ("b", "")]) == ["a"]


def test_jdbc_options_split_by_key():
    options = tables.jdbc_options("jdbc:x", "t", "id", 0, 100, 4)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "4" and options["fetchsize"] == "1000"


def test_full_copy_replaces_and_counts(spark, tmp_path):
    path = str(tmp_path / "copy")
    for _ in range(2):
        observed = tables.write_full(spark.range(7).toDF("id"), path)
        assert observed.get["n_rows"] == 7
    assert tables.read_full(spark, path).count() == 7
    # a copy that did not finish is not read
    spark.range(2).toDF("id").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/version=2")
    assert tables.read_full(spark, path).count() == 7
    tables.write_full(spark.range(4).toDF("id"), path)
    tables.write_full(spark.range(5).toDF("id"), path)
    assert tables.read_full(spark, path).count() == 5
    assert finished_numbers(spark, f"{path}/version=") == [2, 3]


def test_appended_rows_are_added(spark, tmp_path):
    path = str(tmp_path / "log")
    for count in (3, 4):
        tables.append_rows(spark.range(count).toDF("id"), path)
    assert spark.read.parquet(path).count() == 7


def test_table_sync_takes_schema_key_and_count_from_the_source(spark, tmp_path):
    columns = [("code", "varchar(9)", True, ""), ("id", "int(11) unsigned", False, "PRI"), ("price", "decimal(8,2)", True, "")]
    source = spark.createDataFrame([("a", 1, 2.5, "extra"), (None, 2, None, "extra")], "code string, id int, price double, more string")
    target, copied = tables.sync_table(source, columns, "synced_prices", buckets=3, path=str(tmp_path / "synced"))
    assert [f.dataType.simpleString() for f in target.schema] == ["string", "bigint", "decimal(8,2)"]
    assert sorted(map(tuple, target.select("id", "code").collect())) == [(1, "a"), (2, None)] and copied.get["n_rows"] == 2


def test_bucketed_table_joins_without_shuffle(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id * 2 AS twice")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bank LOCATION '{tmp_path}/bank.db'")
    for name in ("bank.left_side", "bank.right_side"):
        tables.create_table(rows, name, ["id"], buckets=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bank.left_side").join(spark.table("bank.right_side").drop("twice"), "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bank CASCADE")


def test_rows_do_not_depend_on_the_columns_read(spark, tmp_path):
    for separator in (",", "|", "\t"):
        lines = ["question_id,content,answer", "1,a,b", "2,short", "3,a,b,c,d", "", "4,,b"]
        path = put(tmp_path, f"m{ord(separator)}.csv", "\n".join(lines).replace(",", separator) + "\n")
        rows = files.load_export(spark, path, separator)
        assert rows.count() == len(rows.collect()) == 3
        assert [r.question_id for r in rows.select("question_id").collect()] == ["1", "2", "4"]
        assert sum(r["count"] for r in rows.groupBy("answer").count().collect()) == 3
        assert rows.filter("question_id = '4'").first().content is None
        rejected = files.rejected_lines(spark, path, separator).collect()
        assert [(r.line.split(separator)[0], r.n_cells) for r in rejected] == [("3", 5)]


def test_options_are_found_by_all_rows(spark, tmp_path):
    lines = [f"{i},s,,t,,g,,,d,,text,{'A. x' if i >= 1000 else ''},ans,list,ana" for i in range(3000)]
    rows = files.load_legacy(spark, put(tmp_path, "late.csv", "\n".join(lines) + "\n"), ",")
    assert rows.filter("options = 'A. x'").count() == 2000
