"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import stored
from callgauge.session import materialize


def _summary(edges: DataFrame) -> tuple:
    row = edges.select(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    ).first()
    return row["n"], row["sum"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its least node.

    Every round hangs nodes below the least neighbour they know. Minima are aggregated and
    joined back, so a node with any number of neighbours gathers nowhere.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    before = None
    while (now := _summary(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # stored, so that the many neighbours of one node can be split in the join
        below = both.filter("b > a").join(stored(least, "least"), "a")
        large = (
            below.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = materialize(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
