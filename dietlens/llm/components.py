"""Connected components of an edge table by alternating star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dietlens.llm.common import join_counted
from dietlens.session import materialize


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links the larger neighbours of each node to its smallest neighbour or itself."""
    ends = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"), F.lit(0).alias("up"))
    )
    least = ends.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"), F.sum("up").alias("n_up"))
    least = materialize(least.filter("n_up > 0").withColumnRenamed("node", "lo"), "least")
    return join_counted(edges, least, ["lo"], "n_up", n).select(F.col("least").alias("lo"), "hi").filter("lo < hi").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links the smaller neighbours of each node, and the node, to the smallest of them."""
    least = materialize(edges.groupBy("hi").agg(F.min("lo").alias("least"), F.count("*").alias("n_down")), "least")
    moved = join_counted(edges, least, ["hi"], "n_down", n).select("least", F.col("lo").alias("hi"))
    stars = moved.unionByName(least.select("least", "hi"))
    return stars.select(F.col("least").alias("lo"), "hi").filter("lo < hi").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edges but the roots; a root is the least node of its component.

    The number of rounds grows with the logarithm of the longest path. A node's edges are pre-aggregated before the
    shuffle, and nodes with very many edges are joined by broadcast, see `join_counted`.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct()
    stars = materialize(pairs, "edges")
    state = None
    while True:
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = now
        stars = materialize(_large_star(stars, now[0]), "edges")
        stars = materialize(_small_star(stars, stars.count()), "edges")
