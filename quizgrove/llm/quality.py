"""Quality rules: gradient-boosted trees over document statistics (operator 10).

The statistics come from one pass over each text. The trees are grown here, by histograms, on a bounded
sample of labelled documents, with monotonic constraints, and are flattened into arrays that score a batch
of documents at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizgrove.llm.common import new_name

#: Labelled documents that the trees are grown on, at most: those with the least hash of their id.
SAMPLE_ROWS = 8_000
#: Share of the good documents of the held-out sample that must score above the threshold.
KEEP_GOOD = 0.998

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NO_SYMBOL = re.compile(r"[^#*$%&|<>]+")
NO_MARK = re.compile(r"[^!?]+")
NO_UPPER = re.compile(r"[^A-Z]+")
NO_DIGIT = re.compile(r"[^0-9]+")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_chars", "n_lines", "n_marks", "n_upper", "n_digits", "n_short_lines")
COUNTS_DDL = ", ".join(f"{name} long" for name in COUNTS)

#: What the trees see, and the way each may push the score: -1 down as it rises, 0 either way.
FEATURES = {
    "word_length": 0,
    "symbols_per_word": -1,
    "duplicate_lines": -1,
    "repeated_words": -1,
    "marks_per_word": -1,
    "upper_share": -1,
    "digit_share": -1,
    "short_lines": 0,
}


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in ``COUNTS``; all zero for null and empty texts."""
    if not text:
        return (0,) * len(COUNTS)
    words = WORD.findall(text)
    n = len(words)
    seen, duplicates, lines, short = set(), 0, 0, 0
    for line in text.split("\n"):
        if not WORD.search(line):
            continue
        lines += 1
        short += len(line) < 30
        duplicates += line in seen
        seen.add(line)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + 5 - max(i, end)
                end = i + 5
    upper = len(NO_UPPER.sub("", text))
    return (
        n,
        sum(map(len, words)),
        len(NO_SYMBOL.sub("", text)),
        duplicates,
        repeated,
        len(text),
        lines,
        len(NO_MARK.sub("", text)),
        upper,
        len(NO_DIGIT.sub("", text)),
        short,
    )


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of ``FEATURES`` from arrays of ``COUNTS``."""
    c = {name: np.asarray(counts[name], dtype=np.float64) for name in COUNTS}
    words, letters, lines = (np.maximum(c[name], 1) for name in ("n_words", "word_chars", "n_lines"))
    return np.column_stack(
        [
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_marks"] / words,
            c["n_upper"] / letters,
            c["n_digits"] / letters,
            c["n_short_lines"] / lines,
        ]
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


@dataclass(frozen=True)
class Trees:
    """Boosted trees in flat arrays: a node's feature, threshold, children (a leaf is its own) and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality, all rows and trees a level at a time."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return out + self.value[node].sum(axis=1)

    def keeps(self, x: np.ndarray) -> np.ndarray:
        return self.score(x) >= self.cut


def keep_all() -> Trees:
    """Trees that reject nothing, for corpora without labels of both kinds."""
    none = np.zeros(0)
    whole = np.zeros(0, dtype=np.int64)
    return Trees(whole, none, whole, whole, none, whole, 0, 0.0, -np.inf)


def grow(
    x: np.ndarray,
    good: np.ndarray,
    directions: tuple[int, ...],
    n_trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    smoothing: float = 5.0,
) -> Trees:
    """Newton boosting of the log loss with histograms.

    A split on a constrained feature must order its children's values, and passes their middle down as a
    bound, so that the whole score is monotonic in that feature.
    """
    rate_of_good = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate_of_good / (1 - rate_of_good)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, score = [], np.full(len(x), bias)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = good - p, p * (1 - p)

        def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
            own = len(nodes)
            g, h = gradient[rows].sum(), weight[rows].sum()  # noqa: B023
            here = float(np.clip(g / (h + smoothing), low, high))
            nodes.append([0, 0.0, own, own, rate * here])
            best = split(binned[rows], gradient[rows], weight[rows], edges, directions, smoothing, low, high) if level < depth else None  # noqa: B023
            if best is None:
                score[rows] += rate * here
                return own
            j, k, a, b = best
            middle, goes = (a + b) / 2, binned[rows, j] <= k
            bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}
            to_left, to_right = bounds[directions[j]]
            nodes[own][:2] = [j, float(edges[j][k])]
            nodes[own][2] = build(rows[goes], level + 1, *to_left)
            nodes[own][3] = build(rows[~goes], level + 1, *to_right)
            return own

        roots.append(build(np.arange(len(x)), 0, -np.inf, np.inf))
    feature, threshold, left, right, value = (np.array(column) for column in zip(*nodes, strict=True))
    return Trees(feature, threshold, left, right, value, np.array(roots), depth, bias, 0.0)


def split(binned, gradient, weight, edges, directions, smoothing, low, high):
    """The best (feature, edge, left value, right value), or None if no split gains."""
    best, gain = None, 1e-6
    g, h = gradient.sum(), weight.sum()
    for j, own in enumerate(edges):
        if not len(own):
            continue
        gs = np.cumsum(np.bincount(binned[:, j], gradient, len(own) + 1))[:-1]
        hs = np.cumsum(np.bincount(binned[:, j], weight, len(own) + 1))[:-1]
        a = np.clip(gs / (hs + smoothing), low, high)
        b = np.clip((g - gs) / (h - hs + smoothing), low, high)
        gains = gs**2 / (hs + smoothing) + (g - gs) ** 2 / (h - hs + smoothing) - g**2 / (h + smoothing)
        gains[(hs < 1) | (h - hs < 1) | ((b - a) * directions[j] < 0)] = 0
        k = int(np.argmax(gains))
        if gains[k] > gain:
            best, gain = (j, k, a[k], b[k]), gains[k]
    return best


def count_texts(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct of ``COUNTS`` in the new column ``name``."""

    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([text_counts(text) for text in batch], columns=COUNTS)

    return docs.withColumn(name, F.pandas_udf(counted, COUNTS_DDL)(F.col("text")))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``sample_rows`` labelled documents, chosen by a hash of the id.

    Every fifth of them is held out: the threshold is the score that ``KEEP_GOOD`` of its good documents reach,
    but not above even odds. Labels that are null, contradict each other or name no document are left out;
    without both kinds of label nothing is rejected.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    known = known.select("doc_id", F.col("low").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most sample_rows rows
    # one row an id: repeated ids can't make the sample larger than its bound
    rows = count_texts(texts, "counts").groupBy("doc_id", "quality").agg(F.min("counts").alias("counts"))
    rows = rows.select("doc_id", "quality", "counts.*").toPandas().sort_values("doc_id", ignore_index=True)
    good = rows["quality"].to_numpy(dtype=np.float64)
    if len(np.unique(good)) < 2:
        return keep_all()
    x, held = features({name: rows[name] for name in COUNTS}), np.arange(len(rows)) % 5 == 4
    if len(np.unique(good[~held])) < 2 or not (good[held] == 1).any():
        held[:] = False
    trees = grow(x[~held], good[~held], tuple(FEATURES.values()))
    judged = held if held.any() else ~held
    cut = min(0.0, float(np.quantile(trees.score(x[judged & (good == 1)]), 1 - KEEP_GOOD)))
    return Trees(**{**trees.__dict__, "cut": cut})


def judge(docs: DataFrame, trees: Trees, name: str) -> DataFrame:
    """``docs`` with ``name``: a struct of ``COUNTS``, base_failed and kept.

    All rows and columns stay. Null and empty texts have no words and so fail the base rules; repeated rows
    get the same verdict; a very long text is counted whole.
    """
    ddl = f"{COUNTS_DDL}, kept boolean"

    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = pd.DataFrame([text_counts(text) for text in batch], columns=COUNTS)
            rows["kept"] = trees.keeps(features({c: rows[c] for c in COUNTS}))
            yield rows

    inner = new_name(docs, "judged")
    found = docs.withColumn(inner, F.pandas_udf(judged, ddl)(F.col("text")))
    failed = base_failed(F.col(f"{inner}.n_words"), F.col(f"{inner}.n_repeat_words"))
    parts = [F.col(f"{inner}.{column}").alias(column) for column in COUNTS]
    kept = (~failed & F.col(f"{inner}.kept")).alias("kept")
    return found.withColumn(name, F.struct(*parts, failed.alias("base_failed"), kept)).drop(inner)


def quality_table(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each row of ``docs``."""
    found = judge(docs.select("doc_id", "text"), train(docs, labels, sample_rows), "verdict")
    return found.select("doc_id", *(f"verdict.{name}" for name in BASE), "verdict.base_failed", "verdict.kept")


def kept_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    verdict = new_name(docs, "verdict")
    return judge(docs, train(docs, labels, sample_rows), verdict).filter(F.col(verdict)["kept"]).select(*docs.columns)
