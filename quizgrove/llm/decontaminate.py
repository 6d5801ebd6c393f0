"""Benchmark decontamination by a distributed positional inverted index (operator 4), DataFrame functions only.

The index stores a posting (term, document, position) for each occurrence of a test term in the training texts; terms are
64-bit hashes of words, so that a hash two words share can only add candidates, which the last check
removes. Postings of words that no test item has could never be read and are not stored.

A phrase's terms are ranked by the length of their lists. The lists of its rarest terms, shifted by the term's
place in the phrase, are intersected: what is left are the places where all of them stand at their
distance. Only these are compared with the texts, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizgrove.llm.common import ascii_lower, counted, shuffled, text_key
from quizgrove.session import saved

PHRASE_WORDS = 10
#: Lists that are intersected before the texts are looked at.
LISTS = 3

#: Runs of letters, ASCII digits and characters beyond ASCII; capitals are lowered afterwards. Said by what it
#: holds: Java's matcher takes many times as long over the same class as a complement of ranges.
WORDS = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def term(word: Column) -> Column:
    return F.xxhash64(ascii_lower(word))


def phrases(items: DataFrame, length: int) -> DataFrame:
    """phrase (its lowered words, joined by spaces) and item_id: each run of ``length`` words of each item.

    An item with fewer words, but not none, is one phrase.
    """
    rows = items.select("item_id", F.transform(words(F.col("text")), ascii_lower).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - length, F.lit(0)) + 1
    rows = rows.select("item_id", "w", F.explode(F.sequence(F.lit(1), last)).alias("begin"))
    part = F.slice("w", F.col("begin"), F.lit(length))
    return rows.select("item_id", F.array_join(part, " ").alias("phrase")).distinct()


def distinct_phrases(items: DataFrame, length: int) -> DataFrame:
    """phrase, its number of words and an id of 128 bits, once each."""
    each = phrases(items, length).select("phrase").distinct()
    return saved(each.select(F.unhex(F.md5("phrase")).alias("id"), F.size(F.split("phrase", " ")).alias("size"), "phrase"), "phrases")


def vocabulary(each: DataFrame) -> DataFrame:
    found = each.select(F.explode(F.split("phrase", " ")).alias("word")).select(F.xxhash64("word").alias("term"))
    return saved(found.distinct(), "test-terms")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings: term, doc_id, text_key (64 bits of the text) and position from 0 on."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(words(F.col("text"))).alias("position", "word"))
    rows = rows.select("doc_id", "text_key", "position", term(F.col("word")).alias("term"))
    return saved(rows.join(counted(terms), "term"), "postings")


def ranked_terms(each: DataFrame, postings: DataFrame) -> DataFrame:
    """id, size, term, offset and rank: the terms of each phrase from the shortest list on.

    ``each`` is one row a phrase. Terms without postings count as lists of no length.
    """
    lengths = saved(postings.groupBy("term").agg(F.count("*").alias("postings")), "list-lengths")
    places = each.select("id", "size", F.posexplode(F.split("phrase", " ")).alias("offset", "word"))
    places = places.withColumn("term", F.xxhash64("word")).drop("word")
    places = places.join(counted(lengths), "term", "left")
    order = Window.partitionBy("id").orderBy(F.coalesce("postings", F.lit(0)), "offset")
    return places.withColumn("rank", F.row_number().over(order)).drop("postings")


def candidates(postings: DataFrame, ranked: DataFrame, lists: int = LISTS) -> DataFrame:
    """id, size, doc_id, text_key and begin where the ``lists`` rarest terms stand at their distance.

    The shortest list of a phrase gives the begins; each further one must have a posting at its distance from them.
    Postings are shuffled by their own place, which no frequent term makes hot.
    """
    ranked = saved(ranked.filter(F.col("rank") <= lists), "ranked-terms")
    first = counted(ranked.filter("rank = 1").select("term", "id", "size", "offset"))
    begin = (F.col("position") - F.col("offset")).alias("begin")
    found = postings.join(first, "term").select("id", "size", "doc_id", "text_key", begin).filter("begin >= 0")
    for rank in range(2, lists + 1):
        own = ranked.filter(F.col("rank") == rank).select("id", "term", "offset")
        found = found.join(counted(own), "id", "left")
        wanted = found.withColumn("position", F.col("begin") + F.col("offset"))
        useful = postings.join(counted(own.select("term").distinct()), "term", "left_semi")
        useful = useful.select(*(F.col(name).alias(f"p_{name}") for name in ("term", "doc_id", "text_key", "position")))
        here = (
            (F.col("term") == F.col("p_term"))
            & F.col("doc_id").eqNullSafe(F.col("p_doc_id"))
            & (F.col("text_key") == F.col("p_text_key"))
            & (F.col("position") == F.col("p_position"))
        )
        short = wanted.filter("term IS NULL")  # the phrase has fewer terms
        found = wanted.filter("term IS NOT NULL").join(shuffled(useful), here, "left_semi").unionByName(short)
        found = found.select("id", "size", "doc_id", "text_key", "begin")
    return found


def exact_matches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, n_words and hits, those candidates of ``found`` that its text has.

    A document's candidates are at most as many as its words times the phrases that agree in their rarest terms.
    """
    listed = F.array_sort(F.collect_set(F.struct("begin", "size", "phrase"))).alias("places")
    by_doc = found.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(listed)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    here = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    rows = rows.join(by_doc, here, "left").select("doc_id", "text_key", words(F.col("text")).alias("w"), "places")
    stands = F.filter(
        "places",
        lambda p: ascii_lower(F.array_join(F.slice("w", p["begin"] + 1, p["size"]), " ")) == p["phrase"],
    )
    count = F.coalesce(F.size("w"), F.lit(0)).cast("long")
    return rows.select("doc_id", "text_key", F.greatest(count, F.lit(0)).alias("n_words"), stands.alias("hits"))


def covered(hits: Column) -> Column:
    """Words inside at least one hit; ``hits`` are ordered by begin."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(state: Column, hit: Column) -> Column:
        end = F.greatest(state["end"], hit["begin"] + hit["size"])
        return F.struct(end.alias("end"), (state["n"] + end - F.greatest(state["end"], F.least(hit["begin"], end))).alias("n"))

    return F.coalesce(F.aggregate(hits, zero, add, lambda state: state["n"]), F.lit(0).cast("long"))


def phrase_matches(docs: DataFrame, items: DataFrame, length: int = PHRASE_WORDS, lists: int = LISTS) -> DataFrame:
    """doc_id, text_key, n_words and hits (begin, size, phrase) of each row of ``docs``; hits is null or empty without any.

    Nulls have no words; a null id is an id like others; equal rows have equal hits. Without items or documents
    there are no hits.
    """
    each = distinct_phrases(items, length)
    postings = index(docs, vocabulary(each))
    found = candidates(postings, ranked_terms(each, postings), lists)
    return exact_matches(docs, found.join(counted(each.drop("size")), "id"))


def proximity_matches(docs: DataFrame, items: DataFrame, length: int = PHRASE_WORDS, lists: int = 2, slop: int = 3) -> DataFrame:
    """phrase, doc_id, text_key: all terms of the phrase stand in the text in any order, each at most ``slop`` words
    off its place relative to the rarest. The ``lists`` rarest give the candidates; for the others only the postings
    near a candidate are looked up.
    """
    each = distinct_phrases(items, length)
    postings = index(docs, vocabulary(each))
    every = saved(ranked_terms(each, postings), "ranked-terms")
    begins = postings.join(counted(every.filter(F.col("rank") <= lists)), "term").withColumn("begin", F.col("position") - F.col("offset"))
    first = begins.filter("rank = 1").select("id", "size", "doc_id", "text_key", "begin").distinct()
    # begins at most slop apart lie in the same or the next of strips as wide as slop
    strip = F.floor(F.col("begin") / (slop + 1))
    near = first.withColumn("strip", F.explode(F.array(strip - 1, strip, strip + 1)))
    other = begins.filter("rank > 1").select("id", "rank", F.col("doc_id").alias("other_id"), "text_key", F.col("begin").alias("other"), strip.alias("strip"))
    pairs = near.join(other, ["id", "text_key", "strip"]).filter(F.col("doc_id").eqNullSafe(F.col("other_id")))
    pairs = pairs.filter(F.abs(F.col("begin") - F.col("other")) <= slop)
    ranks = pairs.groupBy("id", "size", "doc_id", "text_key", "begin").agg(F.countDistinct("rank").alias("ranks"))
    both = ranks.filter(F.col("ranks") == F.least(F.col("size"), F.lit(lists)) - 1).drop("ranks")
    both = saved(both.unionByName(first.filter(F.least(F.col("size"), F.lit(lists)) == 1)), "near-terms")
    wanted = both.join(counted(every.filter(F.col("rank") > lists).select("id", "term", "offset", "rank")), "id")
    strip = F.floor((F.col("begin") + F.col("offset")) / (slop + 1))
    wanted = wanted.withColumn("strip", F.explode(F.array(strip - 1, strip, strip + 1)))
    place = F.floor(F.col("position") / (slop + 1)).alias("strip")
    useful = postings.select("term", F.col("doc_id").alias("other_id"), "text_key", "position", place)
    pairs = wanted.join(useful, ["term", "text_key", "strip"]).filter(F.col("doc_id").eqNullSafe(F.col("other_id")))
    pairs = pairs.filter(F.abs(F.col("begin") + F.col("offset") - F.col("position")) <= slop)
    ranks = pairs.groupBy("id", "size", "doc_id", "text_key", "begin").agg(F.countDistinct("rank").alias("ranks"))
    whole = ranks.filter(F.col("ranks") == F.col("size") - lists).drop("ranks")
    found = whole.unionByName(both.filter(F.col("size") <= lists)).select("id", "doc_id", "text_key").distinct()
    return found.join(counted(each.drop("size")), "id").drop("id")


def contamination(docs: DataFrame, items: DataFrame, length: int = PHRASE_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``docs``.

    A word is hit inside any occurrence of a phrase. items_sha256 is of the ids (sorted as strings, comma-joined) of
    the items with an occurring phrase, of the empty string if there are none; a null item id is left out of it and
    not counted. Rows with equal id and text are reported once for each row.
    """
    hits = saved(phrase_matches(docs, items, length), "phrase-hits")
    named = phrases(items, length).filter("item_id IS NOT NULL").select("phrase", F.col("item_id").cast("string").alias("item"))
    pairs = hits.select("doc_id", "text_key", F.explode("hits.phrase").alias("phrase")).distinct()
    items_of = pairs.join(counted(saved(named, "phrase-items")), "phrase").groupBy(
        F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")
    )
    items_of = items_of.agg(F.array_sort(F.collect_set("item")).alias("items"))
    here = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    rows = hits.join(items_of, here, "left").withColumn("n_hit", covered(F.col("hits")))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, length: int = PHRASE_WORDS) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns."""
    hits = phrase_matches(docs, items, length).filter(F.size("hits") > 0)
    hit = saved(hits.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).distinct(), "contaminated")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.struct(*docs.columns).alias("doc"))
    here = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    return rows.join(counted(hit), here, "left_anti").select("doc.*")
