"""Repeated passages in short lines and inside long ones."""

from __future__ import annotations

import random
import re

from quizgrove.llm import passages

SHORT_LINES = "\n".join(" ".join(f"w{i}x{j}" for j in range(15)) for i in range(6))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def left(docs, min_words=20):
    return {r["doc_id"]: r["text"] for r in passages.without_passages(docs, min_words).collect()}


def plain(rows, size):
    """(doc_id, the words that stay) of each of ``rows``; rows are in the order in which the first place stays."""
    first, kept = {}, []
    for place, (doc_id, text) in enumerate(rows):
        words = [w.decode("utf-8") for w in text.encode().lower().split()]
        gone = set()
        for i in range(len(words) - size + 1):
            of, at = first.setdefault(tuple(words[i : i + size]), (place, i))
            if (of, at) != (place, i):
                gone.update(range(max(i, at + size) if of == place else i, i + size))
        kept.append((doc_id, [w for i, w in enumerate(words) if i not in gone]))
    return kept


def test_short_lines_that_repeat_go(spark):
    rows = [(1, SHORT_LINES), (2, SHORT_LINES.upper()), (3, f"own three\n{SHORT_LINES}\nend"), (4, "short line"), (5, "short line"), (6, None), (7, "")]
    assert left(documents(spark, rows)) == {1: SHORT_LINES, 2: "", 3: "own three\nend", 4: "short line", 5: "short line", 6: None, 7: ""}


def test_equal_rows_are_one_document_and_null_is_first(spark):
    docs = documents(spark, [(1, f"a {SHORT_LINES}"), (1, f"a {SHORT_LINES}"), (None, f"b {SHORT_LINES}")])
    found = [(r["doc_id"], r["text"]) for r in passages.without_passages(docs).collect()]
    assert sorted(found, key=repr) == [(1, "a"), (1, "a"), (None, f"b {SHORT_LINES}")]
    assert passages.passage_table(docs.limit(0)).collect() == []


def test_one_copy_of_an_overlapping_run_stays(spark):
    rows = [(1, "der " * 100), (2, "x " + "der " * 30)]
    assert left(documents(spark, rows)) == {1: "der " * 20, 2: "x "}


def test_random_texts_match_the_plain_version(spark):
    generator = random.Random(4)
    for size in (1, 3, 6):
        rows = []
        for i in range(60):
            own = [f"É{generator.randrange(3 * size)}" for _ in range(generator.randrange(40))]
            if rows and generator.random() < 0.6:
                taken = generator.choice(rows)[1].split()
                at = generator.randrange(len(own) + 1)
                own[at:at] = taken[generator.randrange(len(taken) + 1) :]
            rows.append((i, "".join(word + generator.choice([" ", "\n", "\t "]) for word in own)))
        found = left(documents(spark, rows), size)
        wanted = plain(rows, size)
        assert sum(len(words) for _, words in wanted) < sum(len(text.split()) for _, text in rows)
        for doc_id, words in wanted:
            assert re.sub(r"\s+", " ", found[doc_id]).split() == [w.replace("é", "É") for w in words]


def test_a_passage_inside_a_longer_line_goes(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    before, after = (" ".join(f"{side}{i}" for i in range(200)) for side in "ab")
    rows = [(1, f"x {passage} y"), (2, f"{before} {passage} {after}"), (3, f"{before} {passage}\nnext"), (4, " ".join(passage.split()[:19]))]
    start = len(before)
    found = {r["doc_id"]: (r["text"], r["spans"]) for r in passages.without_passages(documents(spark, rows)).collect()}
    assert found[1] == (rows[0][1], None) and found[4] == (rows[3][1], None)
    assert found[2][0] == f"{before} {after}" and [tuple(s) for s in found[2][1]] == [(start, start + 1 + len(passage))]
    assert found[3][0] == "next"
