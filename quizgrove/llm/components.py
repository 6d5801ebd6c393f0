"""Connected components of a graph kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizgrove.llm.common import sent
from quizgrove.session import saved


def components(edges: DataFrame) -> DataFrame:
    """node and the least node that its edges (a, b) reach, for each node with an edge to another.

    Large-star and small-star steps: each round links, in turn, a node's larger and its smaller neighbours to the
    least one it knows; the edges never become more. Rounds are as many as the logarithm of the
    nodes, each written to shared storage, and end when a round changes nothing. Nodes with very many
    neighbours only need the least of them, found by an aggregate, saved and joined back as Spark splits skewed
    joins, so no node's neighbours are gathered in one task.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges, state = saved(edges, "edges"), None
    most = edges.count()
    while True:
        edges = saved(star(star(edges, most, larger=True), most, larger=False), "edges", most)
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    # stable edges are stars: each node's smaller neighbour is its component
    hubs = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(hubs)


def star(edges: DataFrame, most: int, larger: bool) -> DataFrame:
    """One step: for each node, its neighbours above it (``larger``) or below it and itself go to the least one.

    ``edges`` are ``most`` at most.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        linked = both.filter("b > a").join(sent(saved(least, "least", 2 * most), 2 * most), "a").select(F.col("least").alias("a"), "b")
        return linked.distinct()
    least = saved(edges.groupBy("b").agg(F.min("a").alias("least")), "least", most)
    linked = edges.join(sent(least, most), "b")
    own = least.select(F.col("least").alias("a"), "b")
    others = linked.select(F.col("least").alias("a"), F.col("a").alias("b")).filter("a < b")
    return own.unionByName(others).distinct()
