"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftkit.llm.common import written


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's smallest
    neighbour (itself included)."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of these."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between bigint nodes -> (node, root): the smallest node
    that each linked node reaches, for all nodes but the roots.

    Alternating star contraction: each round is joins and map-side combined
    minima over the edge table, written to the shared checkpoint folder; a
    hub's edges are spread by AQE's skew join.  Links of a node to itself,
    repeated links and links in both directions change nothing; no links
    give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    while True:
        n = e.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
        if n[0] == n[1] and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        e = written(_small_star(_large_star(e).distinct()).distinct(), "edges")
