"""URL rules, WARC archives and source mixes."""

from __future__ import annotations

import hashlib
import random

import pytest

from pyspark.sql import functions as F

from quizgrove.llm import mixing, url_rules, warc
from quizgrove.session import new_folder
from tests.llm import brute


def pages(spark, rows):
    return spark.createDataFrame([(*row, "x", 1) for row in rows], "page_id long, url string, html string, host string, digest int")


def test_rules(spark):
    urls = {
        "http://A.Example.NET/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/english": ("example.net", "/english", "net/", "block"),
        "http://myexample.net/en/": ("myexample.net", "/en/", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://x.net:80/": ("x.net:80", "/", None, "allow"),
        "http://a.b.org/fr/?q": ("a.b.org", "/fr/", "org/fr/", "allow"),
        "http://a.b.org/FR/": ("a.b.org", "/FR/", None, "allow"),
        "https://example.com/de/x#y": ("example.com", "/de/x", "example.com/de/", "block"),
        "https://example.com/a?utm_source=feed": ("example.com", "/a", None, "block"),
        "https://example.com/a?my_utm_sources=feed": ("example.com", "/a", None, "allow"),
        "https://example.com/bestcasino99": ("example.com", "/bestcasino99", None, "allow"),
        "https://example.com/casino99": ("example.com", "/casino99", None, "block"),
        "https://example.com/x.PDF": ("example.com", "/x.PDF", None, "block"),
        "mailto:a@b.net/": ("", "", None, "allow"),
        "://net/a b\nc": ("net", "/a b\nc", "net/", "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "") for i, u in enumerate(urls)] + [(None, "http://net/", ""), (3, "http://net/", "")]
    found = url_rules.url_verdicts(pages(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r["page_id"]: tuple(r)[1:] for r in found}
    assert {u: by_id[i] for i, u in enumerate(urls)} == urls
    assert by_id[None] == urls["http://net/"]
    assert url_rules.url_verdicts(pages(spark, rows).limit(0)).collect() == []


def test_rules_are_indexed_by_their_rarest_token(spark):
    tokens = spark.createDataFrame([("net",)] * 5 + [("en",)] * 3 + [("example",)] * 4 + [("",)] * 6, "token string")
    rules = url_rules.rule_frame(spark, (*url_rules.SITES, url_rules.Rule("^casino*", "block")))
    found = {r["rule"]: r["token"] for r in url_rules.rule_index(rules, tokens).collect()}
    assert found["example.net/en/"] == "en" and found["net/"] == "net" and found["^casino*"] == ""
    assert found["org/fr/"] == "fr"  # no url has either: the least


def archive(spark, rows):
    folder = new_folder(spark, "archive")
    warc.write_archive(pages(spark, rows), folder)
    return warc.capture_index(spark, folder)


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    big = "é" * 60 + "\r\n\r\nWARC/1.0\r\n"
    rows = [
        (5, "http://b.org/x", big), (2, "http://a.org/", big), (9, None, big), (None, "http://a.org/", big),
        (1, "http://a.org/", "small"), (3, "http://a.org/", "small"), (4, "bad\r\nurl", None), (6, "http://c.org", ""),
        (7, "http://z.a.org/?Q=1#f", "x" * 100), (7, "http://z.a.org/?Q=1#f", "x" * 100), (8, "http://a.org/", "y" * 99),
    ]
    found = archive(spark, rows).collect()
    got = sorted((repr(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found)
    wanted = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = html == big and page_id != 2
        wanted.append((repr(page_id), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(wanted)
    order = [(r["url_key"], r["captured"], r["page_id"] is None, r["page_id"] or 0) for r in found]
    assert order == sorted(order)
    assert {r["url"] for r in found if r["page_id"] == 4} == {"bad%0D%0Aurl"}
    assert archive(spark, rows[:1]).count() == 1


def test_empty_archive(spark):
    assert archive(spark, [(1, "u", "h")]).filter("page_id = 0").count() == 0
    folder = new_folder(spark, "archive")
    warc.write_archive(pages(spark, [(1, "u", "h")]).limit(0), folder)
    assert warc.capture_index(spark, folder).collect() == []


def test_loser_tree_merges_any_number_of_runs():
    generator = random.Random(4)
    for count in range(10):
        runs = []
        for run in range(count):
            rows = [(f"k{generator.randrange(5)}", "t", generator.choice([None, 1, 2]), "u", 0, "", "", None, f"r{run}", i) for i in range(generator.randint(0, 20))]
            runs.append(sorted(rows, key=warc.order))
        merged = list(warc.LoserTree(runs))
        assert merged == sorted((row for run in runs for row in run), key=warc.order)


def test_url_key():
    assert warc.url_key("https://WWW.a.org/X?q=1#f") == "org,a,www)/x?q=1"
    assert warc.url_key(None) == ")" and warc.url_key("http://a.org?q") == "org,a)?q"


def mix_rows(seed, count=400):
    generator = random.Random(seed)
    sources = ["big"] * 20 + ["a", "b", "", None, "Z", "é"]
    rows = []
    for i in range(count):
        text = None if generator.random() < 0.03 else " ".join("w" * generator.randint(1, 9) for _ in range(generator.randint(0, 40)))
        rows.append((i if generator.random() > 0.05 else None, text, generator.choice(sources)))
    return [*rows, *rows[:10], (7, None, "none"), (8, "", "none")]


@pytest.mark.parametrize("seed,bucket_rows", [(1, 4096), (2, 16)])
def test_mix_matches_plain_version(spark, monkeypatch, seed, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = mix_rows(seed)
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, source string, size int, plan string")
    found = mixing.mix_table(docs).collect()
    sizes, wanted = {}, []
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.BLANKED.findall(text or ""))
    goal = brute.targets(sizes)
    for (doc_id, text, source), n in zip(rows, brute.copies(rows, bucket_rows=bucket_rows), strict=True):
        size = len(brute.BLANKED.findall(text or ""))
        wanted.append((repr(doc_id), size, sizes[source], round(goal[source], 6), size * n))
    got = [(repr(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found]
    assert sorted(got) == sorted(wanted)
    assert abs(sum(goal.values()) - sum(sizes.values())) < 1e-6
    again = mixing.mix_table(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(n for n, r in zip(brute.copies(rows, bucket_rows=bucket_rows), rows, strict=True) if brute.BLANKED.search(r[1] or ""))
    assert mixing.mix_table(docs.limit(0)).collect() == []


def test_large_ending_buckets_are_cut(spark, monkeypatch):
    rows = [(i, " ".join(["字" * (i % 90 + 1)] * (i % 7 + 1)), "ab"[i % 2]) for i in range(600)] + [(None, "x y", "a")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = brute.copies(rows)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    monkeypatch.setattr(mixing, "END_ROWS", 8)
    slim = mixing.drawn(docs, mixing.SEED, "doc_id")
    assert all(r["rows"] <= 8 or r["low"] == r["high"] for r in mixing.budgets(slim, mixing.WEIGHTS, 3).collect())
    found = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_table(docs).collect() if r["doc_id"] is not None}
    # only the one document that closes a source's budget may be another
    assert sum(abs(found[i] - n) for (i, _, _), n in zip(rows, plain, strict=True) if i is not None) <= 4


def test_taken_words_come_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_source = mixing.mix_table(docs.select("doc_id", "text", "source")).join(docs.select("doc_id", "source"), "doc_id")
    for row in by_source.groupBy("source", "target").agg({"taken": "sum", "size": "max"}).collect():
        assert abs(row["sum(taken)"] - row["target"]) <= row["max(size)"] / 2


def test_a_table_of_a_hundred_thousand_rules(spark):
    listed = spark.range(100_000).select(
        F.when(F.col("id") % 2 == 0, F.format_string("site%d.example/", "id")).otherwise(F.format_string("^ad%d^", "id")).alias("rule"),
        F.lit("block").alias("verdict"),
        (F.col("id") % 2 == 0).alias("site"),
    )
    odd = spark.createDataFrame([(None, "block", True), (" ", "block", False), ("x/", "drop", True), ("y/", "allow", None), ("site4.example/ok/", "allow", True), ("site4.example/ok/", "allow", True)], "rule string, verdict string, site boolean")
    given = listed.unionByName(odd)
    assert url_rules.usable(given).filter("NOT ok").count() == 4
    rules = url_rules.rule_table(given)
    assert rules.count() == 100_001
    long_url = "http://z.org/?" + "q=1&" * 50_000 + "/ad77/"
    urls = ["http://www.site4.example/a", "http://site4.example/ok/b", "http://site5.example/", "http://z.org/ad51/x", "http://z.org/ad51x/", "http://z.org/ad50/", long_url, None]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.url_verdicts(rows, rules).collect()}
    assert found == {0: ("site4.example/", "block"), 1: ("site4.example/ok/", "allow"), 2: (None, "allow"), 3: (None, "block"), 4: (None, "allow"),
                     5: (None, "allow"), 6: (None, "block"), 7: (None, "allow")}
