"""Connected components by alternating large and small stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import drop, materialise


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """The edges that link every neighbour of a node (the larger ones, or the smaller ones and itself) to its least neighbour, and a table that they read."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sides = both if large else both.where("v < u")
    least = sides.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    least = materialise(least, "least")  # a join to an aggregate could not be split
    joined = sides.join(least, "u")
    out = joined.where("v > u" if large else "v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("least").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the least node of u's component, for every node u that is not that node itself.

    ``edges`` has long columns u and v. Stars shrink the paths' lengths geometrically; each round is written
    to the shared folder. A hub's edges are spread by Spark's splitting of skewed joins.
    """
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        before, (edges, first) = now, _star(now, large=True)
        edges, second = _star(edges, large=False)
        now = materialise(edges, "stars")
        drop(before, first, second)
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return now
        mark = tuple(row)
