"""Repeated passages, boilerplate lines, near duplicates and benchmark phrases."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quizgrove.llm import common, decontaminate, line_spread, simhash, substring
from quizgrove.llm.components import components
from quizgrove.session import ROWS_A_TASK, saved, shared_folder
from tests.llm import brute

LONG = " ".join(f"word{i}" for i in range(60))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, digest string, text_key int, spans string")


def plain(rows):
    return [(*row, "x", 1, "y") for row in rows]


def cut_texts(spark, rows, **options):
    found = {}
    for row in substring.without_repeats(documents(spark, plain(rows)), **options).collect():
        found.setdefault(row["doc_id"], []).append((row["text"], [tuple(s) for s in row["spans"] or []]))
    return found


def test_repeated_lines_keep_the_first_document(spark):
    rows = [
        (3, f"own three\n{LONG}\nend", "a"),
        (1, f"own one\n{LONG.upper()}\n{LONG}", "b"),
        (2, f"{LONG.replace(' ', '   ')}", "c"),
        (4, "short line", "d"),
        (5, "short line", "d"),
        (6, None, None),
        (None, f"{LONG} null id", "e"),
        (7, f"{LONG} null id", "e"),
        (7, f"{LONG} null id", "e"),
        (8, "", "e"),
        (9, " \n ", "e"),
    ]
    found = cut_texts(spark, rows)
    assert found[1] == [(rows[1][1], [])]  # a document's own repeats stay
    assert found[2] == [("", [(0, len(rows[2][1]))])]
    assert found[3] == [("own three\nend", [(10, 11 + len(LONG))])]
    assert found[4] == found[5] == [("short line", [])]
    assert found[6] == [(None, [])] and found[8] == [("", [])] and found[9] == [(" \n ", [])]
    assert found[None] == [(f"{LONG} null id", [])]
    assert [text for text, _ in found[7]] == ["", ""]
    paragraphs = documents(spark, plain([(1, f"{LONG}\nmore\n\nx", "a"), (2, f"y\n\n{LONG} more", "a")]))
    cut = {r["doc_id"]: r["text"] for r in substring.without_repeats(paragraphs, unit="paragraph").collect()}
    assert cut == {1: f"{LONG}\nmore\n\nx", 2: "y\n\n"}
    assert substring.substring_table(paragraphs.limit(0)).collect() == []


def test_runs_of_short_lines_and_of_sentences_inside_lines_go(spark):
    lines = "\n".join(" ".join(f"l{i}w{j}" for j in range(5)) for i in range(8))  # 40 words, 5 a line
    said = " ".join(f"S{i} " + " ".join(f"said{i}x{j}" for j in range(6)) + "." for i in range(8))  # 56 words, no line end
    few = "\n".join(lines.split("\n")[:5])  # 25 words
    rows = [
        (1, f"head one\n{lines}\ntail one", "a"),
        (2, f"head two\n\n{lines.upper()}\n\ntail two", "a"),
        (3, f"It began so. {said} It ended.", "a"),
        (4, f"Another begin and {said[:10]} cut off. {said} And more of it.\nlast line", "a"),
        (5, f"five\n{few}\nfive", "a"),
        (6, f"six {said.split('. ', 1)[1]} six", "a"),
    ]
    found = cut_texts(spark, rows)
    assert found[1] == [(rows[0][1], [])] and found[3] == [(rows[2][1], [])] and found[5] == [(rows[4][1], [])]
    assert found[2][0][0] == "head two\n\ntail two"
    assert found[4][0][0] == f"Another begin and {said[:10]} cut off. And more of it.\nlast line"
    left = found[6][0][0]  # the sentence that the passage's end shares with the document's own words stays
    assert left.startswith("six S1") and left.endswith(" six") and len(left.split()) < 20
    table = {r["doc_id"]: r for r in substring.substring_table(documents(spark, plain(rows))).collect()}
    assert table[1]["n_shared_words"] == 40 and table[1]["n_removed_words"] == 0 and table[2]["n_removed_words"] == 40
    assert table[5]["n_shared_words"] == 0 and table[5]["removed"] == ""


def test_a_run_that_shorter_documents_hold_together_goes(spark):
    """Documents of 24 words are too short for a run, but their links count for those that come later."""
    a, b, c = (" ".join(f"{name}{j}" for j in range(12)) for name in "abc")
    docs = documents(spark, plain([(1, f"{a}\n{b}", "s"), (2, f"{b}\n{c}", "s"), (3, f"{a}\n{b}\n{c}\nown", "s"), (4, f"{c}\n{a}", "s")]))
    found = {r["doc_id"]: r for r in substring.without_repeats(docs).collect()}
    assert found[3]["text"] == "own" and found[3]["n_removed_words"] == found[3]["n_shared_words"] == 36
    assert all(found[i]["spans"] is None and found[i]["n_shared_words"] == 0 for i in (1, 2, 4))


def test_sentences_that_are_alone_in_common_are_no_run(spark):
    """Two documents that share many single sentences, but never two in a row, are left alone."""
    shared = [" ".join(f"c{i}x{j}" for j in range(8)) + "." for i in range(12)]
    rows = [(d, " ".join(f"{s} own {d} words {i}." for i, s in enumerate(shared)), "a") for d in (1, 2, 3)]
    assert all(spans == [] for [(_, spans)] in cut_texts(spark, rows).values())


def test_a_very_long_text_is_cut_whole(spark):
    body = " ".join(f"A{i} b{i} c{i} d{i}." for i in range(40_000))
    passage = " ".join(f"p{i} q{i} r{i}." for i in range(20))
    found = cut_texts(spark, [(1, f"{passage} The end.", "a"), (2, f"{body} {passage} {body}", "a")])
    assert found[2][0][0] == f"{body} {body}" and len(found[2][0][1]) == 20


def test_lines_on_many_sites_go(spark):
    rows = [(i, f"own {i}\n  All rights reserved \n\nlast {i}", f"s{i % 6}") for i in range(30)]
    rows += [(100 + i, f"once more\nnews {i}", f"s{i % 4}") for i in range(30)]
    rows += [(200, None, "s1"), (201, "All rights reserved", None), (202, "", "s2"), (None, "All rights reserved\nx", "s1"), (3, rows[3][1], "s3")]
    rows += [(300 + i, "of no site", None) for i in range(9)]
    table = line_spread.without_boilerplate(documents(spark, plain(rows)), min_sites=5)
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in table.collect()}
    assert table.count() == len(rows)
    assert found[3] == ("own 3\n\nlast 3", 4, 1)
    assert found[101] == ("once more\nnews 1", 2, 0)
    assert found[200] == (None, 0, 0) and found[201] == ("", 1, 1) and found[202] == ("", 1, 0)
    assert found[None] == ("x", 2, 1) and found[300] == ("of no site", 1, 0)
    assert line_spread.line_table(documents(spark, plain(rows)).limit(0)).collect() == []


def test_sites_near_the_threshold_are_counted(spark):
    rows = [(i, f"line {k}", f"s{i}") for k in (198, 199, 200, 201, 260) for i in range(k)]
    found = line_spread.without_boilerplate(documents(spark, plain(rows)), min_sites=200)
    gone = {r["text"] for r in found.filter("n_removed = 0").select("text").collect()}
    assert gone == {"line 198", "line 199"}


@pytest.mark.parametrize("most", [0, 1, 4, 6])
def test_links_between_fingerprints(spark, most):
    generator = random.Random(most)
    prints = {0}
    for _ in range(12):
        base = generator.getrandbits(64)
        for _ in range(25):
            value = base
            for _ in range(generator.randint(0, 5)):
                value ^= 1 << generator.randrange(64)
            prints.add(value)
    chain = generator.getrandbits(64)
    for bit in range(40):
        chain ^= 1 << bit
        prints.add(chain)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.linked(spark.createDataFrame([(p,) for p in signed], "print long"), most).collect()
    assert {r["print"]: r["component"] for r in found} == brute.classes(signed, most)


def test_near_duplicates(spark):
    generator = random.Random(2)
    texts = [" ".join(f"w{generator.randrange(900)}" for _ in range(generator.randint(1, 300))) for _ in range(60)]
    texts += [t + " more" for t in texts[:20]] + texts[:5] + [None, "", " \t", "A B", "a\nb", "É x y z", "é x y z"]
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)] + [(None, texts[0], "s"), (None, "alone " + texts[9], "s"), (990, texts[10], "s")]
    docs = documents(spark, plain(rows))
    found = simhash.near_duplicates(docs).collect()
    prints = [brute.fingerprint(t) for _, t, _ in rows]
    of, least = brute.classes(set(prints), 4), {}
    for (doc_id, _, _), value in zip(rows, prints, strict=True):
        least[of[value]] = min((x for x in (least.get(of[value]), doc_id) if x is not None), default=None)
    wanted = [(doc_id, f"{value:016x}", least[of[value]]) for (doc_id, _, _), value in zip(rows, prints, strict=True)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    kept = simhash.one_of_each(docs).collect()
    assert kept[0].__fields__ == docs.columns
    assert len(kept) == len(set(of.values())) == len({of[brute.fingerprint(r["text"])] for r in kept})
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_sides_known_to_be_few_are_sent(spark, monkeypatch):
    """Spark takes exploded and stored tables for smaller than they are: here all of them are below its limit."""
    words = [f"w{i * i % 97}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 50], f"own{i % 3}", *words[i % 50 :]]) if i % 4 else f"a b c {i} d", "s") for i in range(200)]
    docs = documents(spark, plain(rows))
    usual = [sorted(map(repr, found(docs).collect())) for found in (simhash.near_duplicates, simhash.one_of_each)]
    plans = []

    def kept(df, *rest):
        plans.append(plan_of(df))
        return saved(df, *rest)

    monkeypatch.setattr(simhash, "saved", kept)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    found = [simhash.near_duplicates(docs), simhash.one_of_each(docs)]
    assert [sorted(map(repr, df.collect())) for df in found] == usual
    plans += map(plan_of, found)
    assert sum("SortMergeJoin" in plan for plan in plans) >= 16 and not any("BroadcastHashJoin" in plan for plan in plans)
    exploded = spark.range(4).select("id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("n"))
    assert "BroadcastHashJoin" in plan_of(spark.range(9).join(common.counted(exploded, 200), "id"))
    assert "BroadcastHashJoin" not in plan_of(spark.range(9).join(common.counted(exploded, 199), "id"))


def test_small_tables_of_near_duplicates_are_few_files(spark):
    words = [f"w{i * i % 97}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 50], f"own{i % 3}", *words[i % 50 :]]) if i % 4 else f"a b c {i} d", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    usual = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    shared = Path(shared_folder(spark).removeprefix("file:"))
    before, there = {key: spark.conf.get(key) for key in wanted}, set(shared.iterdir())
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == usual
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = {}
    for folder in set(shared.iterdir()) - there:
        label = folder.name.rpartition("-")[0]
        files.setdefault(label, []).append(len(list(folder.glob("part-*"))))
    for label in ("distinct-fingerprints", "own-buckets", "shared-buckets", "least", "near-first", "near-components", "near-names"):
        assert files[label] and max(files[label]) <= 1, label
    assert max(sorted(files["edges"])[:-2]) <= 1  # only the first edges of the two graphs aren't counted yet


def test_saved_tables_keep_all_rows_in_tasks_that_follow_them(spark):
    dealt = spark.range(3000).repartition(20, "id")
    for rows, most in ((None, 20), (3000, 1), (2 * ROWS_A_TASK + 1, 3), (0, 1)):
        found = saved(dealt, "few", rows)
        assert len(found.inputFiles()) <= most and sorted(r["id"] for r in found.collect()) == list(range(3000))
    assert len(saved(dealt, "few").inputFiles()) == 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103), (7, 7), (40, 1), (100, 105)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {**dict.fromkeys(range(1, 41), 1), 100: 100, 105: 100, 103: 100}


ITEMS = [
    (1, "The quick brown Fox jumps over the lazy dog and then it runs away from here"),
    (12, "short item"),
    (3, "one"),
    (4, "..."),
    (5, None),
    (6, "École d'été où l'on apprend ce qu'il faut de tout pour vivre"),
    (2, "The quick brown Fox jumps over the lazy dog and then it runs away from here"),
    (None, "an item without an id that has a few words more than ten"),
]


def benchmark(spark):
    return spark.createDataFrame([(*row, "x") for row in ITEMS], "item_id long, text string, phrase string")


def test_postings_are_not_sent(spark):
    """Stored postings take a few bytes a row in their files and many times that in memory."""
    items = benchmark(spark).filter("item_id < 13")
    each = decontaminate.distinct_phrases(items, 10)
    docs = documents(spark, plain([(i, ITEMS[0][1], "s") for i in range(20)]))
    postings = decontaminate.index(docs, decontaminate.vocabulary(each))
    plan = plan_of(decontaminate.candidates(postings, decontaminate.ranked_terms(each, postings))).splitlines()
    assert not [line for line in plan if "BroadcastHashJoin" in line and "p_position" in line]
    assert sum("SortMergeJoin" in line and "p_position" in line for line in plan) >= decontaminate.LISTS - 1


def test_phrases_match_the_plain_version(spark):
    texts = [
        "x, THE quick brown fox jumps over the lazy dog and; then it! end",
        "the quick brown fox jumps over the lazy cat and then it runs away from here",
        "a short item, then another short   item. One short",
        "école d été où l on apprend ce qu il faut de tout pour vivre",
        "École d été où l on apprend ce qu il faut de tout pour vivre",
        "an item without an id that has a few words more",
        None,
        "",
        "the " * 500 + ITEMS[0][1] + " the" * 500 + " " + ITEMS[0][1],
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[2], "s"), (0, "other one", "s")]
    items = [(i, t) for i, t in ITEMS]
    wanted = []
    for doc_id, text, _ in rows:
        n, marked, found = brute.hits(text, items)
        found = [x for x in found if x != "None"]
        wanted.append((doc_id, n, marked, len(found), marked > 0))
    docs = documents(spark, plain(rows))
    found = decontaminate.contamination(docs, benchmark(spark))
    short = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in found.collect()]
    assert sorted(map(repr, short)) == sorted(map(repr, wanted))
    clean = decontaminate.clean_documents(docs, benchmark(spark))
    assert clean.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in clean.collect()) == sorted(repr(w[0]) for w in wanted if not w[4])
    assert decontaminate.contamination(docs.limit(0), benchmark(spark)).collect() == []
    assert not any(r["n_hit"] for r in decontaminate.contamination(docs, benchmark(spark).limit(0)).collect())


def test_random_phrases_match_the_plain_version(spark):
    generator = random.Random(8)
    words = [f"t{i}" for i in range(4)]
    items = [(i, " ".join(generator.choice(words) for _ in range(generator.randint(1, 9)))) for i in range(12)]
    rows = [(i, " ".join(generator.choice(words) for _ in range(generator.randint(0, 60))), "s") for i in range(60)]
    items_df = spark.createDataFrame([(*row, "x") for row in items], "item_id long, text string, phrase string")
    docs = documents(spark, plain(rows))
    for row in decontaminate.contamination(docs, items_df, length=4).collect():
        n, marked, found = brute.hits(rows[row["doc_id"]][1], items, 4)
        assert (row["n_words"], row["n_hit"], row["n_items"]) == (n, marked, len(found))


def test_proximity(spark):
    docs = documents(spark, plain([(1, "fox alpha beta gamma dog", "s"), (2, "dog fox", "s"), (3, "fox a b c d e f g h i j k dog", "s"), (4, "fox", "s")]))
    items = spark.createDataFrame([(1, "fox dog", "x"), (2, "beta", "x"), (3, None, "x")], "item_id long, text string, phrase string")
    found = decontaminate.proximity_matches(docs, items, length=2, lists=2, slop=3)
    assert {(r["phrase"], r["doc_id"]) for r in found.collect()} == {("fox dog", 1), ("fox dog", 2), ("beta", 1)}


def test_proximity_looks_at_every_term(spark):
    rows = [(1, "red fox big dog", "s"), (2, "fox red dog x big", "s"), (3, "red fox", "s"), (4, "big red", "s"), (5, "fox dog", "s"), (None, "red big fox dog", "s")]
    rows += [(10 + i, "fox dog", "s") for i in range(5)]
    docs = documents(spark, plain(rows + [(20, "red fox big a b c d e f g dog", "s")]))
    items = spark.createDataFrame([(1, "red fox big dog", "x")], "item_id long, text string, phrase string")
    for lists in (1, 2, 4):
        found = decontaminate.proximity_matches(docs, items, length=4, lists=lists, slop=3).collect()
        assert sorted(repr(r["doc_id"]) for r in found) == ["1", "2", "None"], lists
