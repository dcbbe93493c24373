"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from subgrade.llm.common import groups_of, written

#: Edges that a file of the written steps holds at least, so that few edges aren't spread over many small files.
FILE_EDGES = 2000


def _least(edges: DataFrame, files: int) -> DataFrame:
    """The smallest neighbour of each u, written, so that the join with a hot u's edges has an exchange on both sides
    and Spark can split it."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "components-least")


def _step(edges: DataFrame, files: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # each node ties its larger neighbours to the smallest node it sees
    large = both.filter("v > u").join(_least(both, files), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    large = written(large.distinct().coalesce(files), "components-large")
    # then itself and its smaller neighbours
    joined = large.join(_least(large, files), "u")
    small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
    return written(small.filter("u > v").distinct().coalesce(files), "components-edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of an edge, from long columns u, v in any order.

    Both ends of each step are tables of at most the edges' size; only a count and a checksum reach the driver. Edges of
    a node to itself, repeated edges and an empty table are fine.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "components-edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen[0] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
        now = _step(now, groups_of(seen[0], FILE_EDGES))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
