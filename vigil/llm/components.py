"""Distributed union-find: connected components by alternating large and small stars
(DataFrame operations only, one written table a round)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vigil.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is hung on the smallest vertex around it."""
    both = _both_ways(edges)
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return (both.join(low, F.col("a") == F.col("c")).filter(F.col("b") > F.col("a"))
                .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller end; the smaller neighbours of a vertex and
    the vertex itself are hung on the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = (edges.join(low.withColumnRenamed("a", "c"), F.col("a") == F.col("c")).filter(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return hung.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and sum of hashes, taken while they are written."""
    seen = Observation()
    state = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    out = written(edges.observe(seen, *state), "edges")
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (id, component) for every vertex that has a link.

    component is the smallest vertex reachable.  The rounds end when the set of edges stays
    the same, that is when it is a star around each component's smallest vertex; their number
    grows with the logarithm of the input.  Self links and repeated links are ignored.
    """
    edges = (edges.filter(F.col("a") != F.col("b"))
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges, state = _written(edges)
    while state[0]:
        edges, now = _written(_small_star(_large_star(edges)))
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
