"""Recommendation over a question table with embeddings, set-wise for many queries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizgrove.functions import text as text_functions
from quizgrove.functions.vectors import hashed_embedding
from quizgrove.operators.access import matching
from quizgrove.operators.similarity import top_k_similar
from quizgrove.session import saved

Embedder = Callable[[list[str]], "np.ndarray"]

# Fixed values of the evaluation.
SEARCH_DEPTH = 15
LIST_LENGTH = 10
RECALL_TARGET = 0.8
MARKED_RECALL_TARGET = 0.6
OVERFETCH = 3
EMBED_BATCH = 64


def embed(
    df: DataFrame, text: str, embedder: Embedder | None = None, batch_size: int = EMBED_BATCH, attempts: int = 5
) -> DataFrame:
    """Adds a unit-length ``embedding`` of a text column.

    Without an embedder the built-in hashed words are used. An
    embedder gets at most ``batch_size`` texts a call and is tried again when it fails.
    """
    if embedder is None:
        return df.withColumn("embedding", hashed_embedding(F.col(text)))

    def call(texts: list[str]) -> np.ndarray:
        for attempt in range(attempts):
            try:
                return np.asarray(embedder(texts), dtype=np.float64)
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(2**attempt)
        raise ValueError("attempts must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text].fillna("").tolist()
            vectors = [call(texts[at : at + batch_size]) for at in range(0, len(texts), batch_size)]
            if not vectors:
                continue
            matrix = np.concatenate(vectors)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield batch.assign(embedding=list(matrix / np.where(norms > 0, norms, 1.0)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, embedding array<double>")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first by ``order`` (W1). Reduced inside each task before the shuffle."""
    rest = [name for name in df.columns if name != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("row"))
    return picked.select(key, "row.*").select(*df.columns)


def _as_queries(items: DataFrame) -> DataFrame:
    return items.select(F.col("question_id").alias("query_id"), "embedding")


def _as_corpus(items: DataFrame) -> DataFrame:
    return items.select(F.col("question_id").alias("item_id"), "embedding")


def queries_by_id(ids: DataFrame, items: DataFrame) -> DataFrame:
    """Query vectors for question ids; an unknown id is an error (R2)."""
    wanted = ids.select(F.col("query_id")).distinct()
    unknown = wanted.join(items.select(F.col("question_id").alias("query_id")), "query_id", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("unknown query_id")
    return wanted.join(_as_queries(items), "query_id")


def queries_by_text(texts: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Query vectors for free texts: query_id, query_text (R2)."""
    return embed(texts, "query_text", embedder).select("query_id", "embedding")


def search(
    queries: DataFrame,
    items: DataFrame,
    top_k: int = 10,
    criteria: Mapping[str, object] | None = None,
    overfetch: int | None = None,
    exclude_self: bool = True,
) -> DataFrame:
    """The ``top_k`` items per query, with their display columns.

    Conditions hold before the cut, so every query gets ``top_k`` if there are that many. With
    ``overfetch`` the cut to ``overfetch * top_k`` comes first and fewer may remain.
    """
    criteria = criteria or {}
    if overfetch is None:
        found = top_k_similar(queries, _as_corpus(matching(items, criteria)), top_k, exclude_self=exclude_self)
        return with_payload(found, items)
    wide = top_k_similar(queries, _as_corpus(items), overfetch * top_k, exclude_self=False)
    if exclude_self:
        wide = wide.filter(F.col("query_id") != F.col("item_id"))
    kept = matching(with_payload(wide, items), criteria)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("rank", place).filter(F.col("rank") <= top_k)


def with_payload(found: DataFrame, items: DataFrame) -> DataFrame:
    """Joins the display columns of the hits, with defaults for missing values."""
    known = set(items.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in known else F.lit("")

    shown = items.select(
        F.col("question_id").alias("item_id"),
        text_functions.preview(text("content")).alias("content"),
        text("options").alias("options"),
        *[
            (F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in known else F.lit(0)).alias(name)
            for name in ("type_id", "grade_id", "subject_id", "difficulty_id")
        ],
    )
    return found.join(shown, "item_id")


def same_type_first(
    queries: DataFrame, items: DataFrame, depth: int = SEARCH_DEPTH, length: int = LIST_LENGTH
) -> DataFrame:
    """Local list: ``depth`` nearest without the query itself, same question type first."""
    types = items.select("question_id", "type_id")
    found = top_k_similar(queries, _as_corpus(items), depth, exclude_self=False).filter(
        F.col("item_id") != F.col("query_id")
    )
    typed = found.join(types.select(F.col("question_id").alias("item_id"), F.col("type_id").alias("item_type")), "item_id")
    typed = typed.join(
        types.select(F.col("question_id").alias("query_id"), F.col("type_id").alias("query_type")), "query_id", "left"
    )
    other = ~F.coalesce(F.col("item_type") == F.col("query_type"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(other, "rank"))
    return (
        typed.withColumn("place", place)
        .filter(F.col("place") <= length)
        .select("query_id", "item_id", "score", "item_type", "place")
    )


# --- evaluation ------------------------------------------------------------------------------


def recall_against(
    queries: DataFrame, local: DataFrame, external: DataFrame, target: float = RECALL_TARGET, empty_is_success: bool = False
) -> DataFrame:
    """Per query: how much of the outside list the local list holds.

    ``local``: query_id, item_id. ``external``: query_id, ext_id. An empty outside list fails unless
    ``empty_is_success``. The matched ids are at most as many as the local list is long.
    """
    pairs = external.select("query_id", F.col("ext_id").alias("item_id")).distinct()
    hits = local.select("query_id", "item_id").distinct().withColumn("hit", F.lit(True))
    counts = (
        pairs.join(hits, ["query_id", "item_id"], "left")
        .groupBy("query_id")
        .agg(
            F.count("*").alias("total"),
            F.count("hit").alias("matched"),
            F.array_join(F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("item_id")))), ",").alias("matched_ids"),
        )
    )
    rate = F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0)
    good = (F.col("total") > 0) & (F.col("matched") >= F.col("total") * target)
    if empty_is_success:
        good = good | (F.col("total") == 0)
    return (
        queries.select("query_id").distinct()
        .join(counts, "query_id", "left")
        .fillna({"total": 0, "matched": 0, "matched_ids": ""})
        .withColumn("recall", F.round(rate, 6))
        .withColumn("success", good)
    )


def unmatched(local: DataFrame, external: DataFrame) -> DataFrame:
    """Outside recommendations the local list misses (U4)."""
    return external.select("query_id", F.col("ext_id").alias("item_id")).distinct().join(
        local.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti"
    )


def ranks_of_marked(found: DataFrame, marked: DataFrame, target: float = MARKED_RECALL_TARGET) -> DataFrame:
    """Per query: how many marked items (query_id, item_id) were found, at which ranks."""
    marked = marked.select("query_id", "item_id").distinct()
    hits = marked.join(found.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left")
    return hits.groupBy("query_id").agg(
        F.count("*").alias("total"),
        F.count("rank").alias("found"),
        F.round(F.avg("rank"), 6).alias("mean_rank"),
        # As many ranks as the searched list is long, at most.
        F.array_join(F.sort_array(F.collect_list("rank")), ",").alias("ranks"),
        (F.count("rank") / F.count("*") >= target).alias("success"),
    )


def growth(base: DataFrame, responses: DataFrame) -> DataFrame:
    """Size of the data set before and after each round of outside responses.

    ``responses``: iteration, question_id. A question counts in the first round that brings it.
    """
    first = responses.groupBy("question_id").agg(F.min("iteration").alias("iteration"))
    fresh = first.join(base.select("question_id"), "question_id", "left_anti").groupBy("iteration").agg(
        F.count("*").alias("added")
    )
    rounds = responses.select("iteration").distinct().join(fresh, "iteration", "left").fillna(0, ["added"])
    total = base.select(F.count_distinct("question_id").alias("n"))
    # One row per round is left here.
    running = F.sum("added").over(Window.orderBy("iteration"))
    return rounds.withColumn("after", total.select("n").scalar() + running).withColumn(
        "before", F.col("after") - F.col("added")
    )


def closed_loop(
    items: DataFrame,
    batches: Sequence[DataFrame],
    add: Callable[[DataFrame, DataFrame], DataFrame],
    search: Callable[[DataFrame, DataFrame | None], DataFrame],
    evaluate: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Rounds of enriching, embedding and evaluating (R11): the items after the last round, and a row for each round.

    ``add(items, batch)`` gives the new rows of a round's outside responses with their embeddings, such as
    ``add_questions``. ``search(items, known)`` gives the list of each query among all items, those that led to the lists ``known``
    (None in the first round) included, such as ``top_k_similar``: a round searches what it adds only. ``evaluate(lists)`` gives total,
    found and success of each query, such as ``ranks_of_marked``. What a round adds and its lists are saved, so that no text is
    embedded twice and the plan grows by one scan.
    """
    rounds, lists = [], None
    for number, batch in enumerate(batches):
        fresh = saved(add(items, batch), "loop-added")
        before, items = items, append(items, fresh)
        lists = saved(search(items if lists is None else fresh, lists), "loop-lists")
        # a stored list takes far less room in its files than in memory, so it is never sent
        outcome = evaluate(lists.hint("merge")).agg(
            F.count("*").alias("queries"), F.count_if("success").alias("successful"),
            F.coalesce(F.sum("found"), F.lit(0)).alias("found"),
            F.round(F.try_divide(F.sum("found"), F.sum("total")), 6).alias("recall"),
        )
        sizes = [side.agg(F.count("*").alias("n")).select("n").scalar().alias(name) for side, name in ((before, "before"), (fresh, "added"))]
        rounds.append(saved(outcome.select(F.lit(number).alias("iteration"), *sizes, *outcome.columns), "loop-round"))
    return items, reduce(DataFrame.unionByName, rounds)


def loop_report(growth_rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Totals over all rounds (A13). ``outcomes``: iteration, success, seconds."""
    joined = outcomes.join(growth_rows.select("iteration", "added"), "iteration", "left")
    return joined.agg(
        F.count("*").alias("iterations"),
        F.count_if("success").alias("successful"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("new_questions"),
        F.round(F.coalesce(F.sum("added"), F.lit(0)) / F.count("*"), 6).alias("new_per_iteration"),
        F.round(F.sum("seconds"), 6).alias("total_seconds"),
        F.round(F.count_if("success") / F.count("*"), 6).alias("success_rate"),
    )


# --- incremental maintenance -----------------------------------------------------------------


def new_rows(known: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Rows of a batch whose id is not known yet, one per id."""
    return keep_first(batch.join(known.select("question_id"), "question_id", "left_anti"), "question_id", order)


def add_questions(
    items: DataFrame, batch: DataFrame, order: str = "seq", embedder: Embedder | None = None
) -> DataFrame:
    """The new rows of a batch with their embeddings, ready to append."""
    fresh = new_rows(items, batch, order)
    content = F.col("content")
    options = F.col("options") if "options" in batch.columns else F.lit("")
    type_id = F.col("type_id") if "type_id" in batch.columns else F.lit(None).cast("int")
    stem = text_functions.build_stem_with_options(content, options, type_id)
    # a filter would be pushed below the column and clean every text twice
    texts = fresh.withColumn("text", F.explode(F.filter(F.array(stem), lambda text: F.length(text) > 0)))
    return embed(texts, "text", embedder)


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, columns matched by name."""
    return left.unionByName(right, allowMissingColumns=True)


PROVIDER_SCHEMA = (
    "array<struct<id:bigint,type_id:int,stem:string,options:string,answer:string,analysis:string>>"
)


def flatten_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """Question rows of outside JSON responses, texts cleaned."""
    rows = responses.select(F.explode(F.from_json(column, PROVIDER_SCHEMA)).alias("r"))
    return rows.select(
        F.col("r.id").alias("question_id"),
        F.coalesce("r.type_id", F.lit(1)).alias("type_id"),
        text_functions.clean_html(F.col("r.stem")).alias("content"),
        *[text_functions.clean_html(F.col(f"r.{name}")).alias(name) for name in ("options", "answer", "analysis")],
    )


def missing_vectors(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Items without an embedding yet."""
    return items.join(vectors.select("question_id"), "question_id", "left_anti")


def consistency(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """One audit row: do items and vectors hold the same ids, each once, without hash clashes."""
    left = items.groupBy("question_id").agg(F.count("*").alias("n_items"))
    right = vectors.groupBy("question_id").agg(F.count("*").alias("n_vectors"))
    both = left.join(right, "question_id", "full").fillna(0, ["n_items", "n_vectors"])
    clashes = (
        both.select(text_functions.stable_id(F.col("question_id")).alias("id64"))
        .groupBy("id64").agg((F.count("*") - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("id_clashes"))
    )
    counts = both.agg(
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("n_vectors"), F.lit(0)).alias("vectors"),
        F.count_if(F.col("n_vectors") == 0).alias("missing"),
        F.count_if(F.col("n_items") == 0).alias("orphans"),
        F.count_if((F.col("n_items") > 1) | (F.col("n_vectors") > 1)).alias("repeated"),
    )
    audit = counts.withColumn("id_clashes", clashes.select("id_clashes").scalar())
    return audit.withColumn(
        "consistent", (F.col("missing") + F.col("orphans") + F.col("repeated") + F.col("id_clashes")) == 0
    )


def candidates(items: DataFrame, minimum: int = 5) -> DataFrame:
    """Rows with a content longer than ``minimum``, or all rows when there is none (P10)."""
    long_enough = F.coalesce(F.length(F.trim("content")) > minimum, F.lit(False))
    some = items.agg(F.max(long_enough).alias("some")).select("some").scalar()
    return items.filter(long_enough | ~F.coalesce(some, F.lit(False)))


def sample_row(items: DataFrame, text: Column, seed: int, minimum: int = 5) -> DataFrame:
    """One repeatable pick: longer contents first, then any row with a text, then any row."""
    long_enough = F.coalesce(F.length(F.trim("content")) > minimum, F.lit(False))
    rank = F.when((F.length(text) > 0) & long_enough, 0).when(F.length(text) > 0, 1).otherwise(2)
    drawn = F.md5(F.concat_ws("/", F.col("question_id").cast("string"), F.lit(str(seed))))
    return items.orderBy(rank, drawn, "question_id").limit(1)


def keyword_pick(items: DataFrame, words: Sequence[str], order: str, last: int = 10) -> DataFrame:
    """Of the last rows, the first with a keyword; without a hit the very last row."""
    tail = items.orderBy(F.col(order).desc()).limit(last)
    content = F.lower(F.col("content"))
    hit = F.lit(False)
    for word in words:
        hit = hit | F.coalesce(F.contains(content, F.lit(word.lower())), F.lit(False))
    marked = tail.withColumn("hit", hit)
    turn = F.when(F.col("hit"), F.col(order)).otherwise(-F.col(order))
    return marked.orderBy(~F.col("hit"), turn).limit(1).drop("hit")


def resorted(found: DataFrame, by: str) -> DataFrame:
    """Result rows in display order: by similarity, grade or difficulty, unknown as 0."""
    keys = {
        "similarity": F.coalesce("score", F.lit(0.0)).desc(),
        "grade": F.coalesce("grade_id", F.lit(0)).asc(),
        "difficulty": F.coalesce("difficulty_id", F.lit(0)).asc(),
    }
    if by not in keys:
        raise ValueError(f"sort must be one of {sorted(keys)}")
    return found.orderBy(keys[by], "query_id", "rank")
